"""Queries: scores, summaries, subject reviews, chunks."""

from pyspark.sql import functions as F

from ..functions import scale
from ..functions.numeric import r6
from ..operators import centroids as cen
from ..operators import scoring as sc
from . import inputs
from .inputs import ITEM_ROWS, SCORED, SCORED_WITH_FAILED, SCORE_EXPR, model
from .registry import query
from .vector_queries import items, readable, roster


def scored(t):
    return sc.score_items(items(t), cen.centroid_models(items(t)))


def scored_with_failed(t):
    """Scores of the readable items; unreadable ones keep a row with null scores."""
    good = sc.score_items(readable(t), cen.centroid_models(readable(t)))
    failed = items(t).where(F.col("reason").isNotNull())
    return good.unionByName(failed, allowMissingColumns=True).drop("embedding")


@query("e1_cosine_zero_guard", f"WITH {ITEM_ROWS} SELECT item_id, round({inputs.cos('w', 'v')}, 6) AS cosine FROM (SELECT item_id, v, list_transform(v, lambda e: e * (item_id % 3)) AS w FROM items)")
def e1(t):
    from ..functions import vectors as vec

    w = F.transform(vec.as_vector("embedding"), lambda e: e * (F.col("item_id") % 3))
    return items(t).withColumn("w", w).select("item_id", r6(vec.cosine("w", vec.as_vector("embedding"))).alias("cosine"))


@query("e2_euclidean", f"WITH {ITEM_ROWS} SELECT item_id, round(list_distance(v, list_reverse(v)), 6) AS euclidean FROM items")
def e2(t):
    from ..functions import vectors as vec

    df = items(t).select("item_id", vec.as_vector("embedding").alias("v"))
    return df.select("item_id", r6(vec.euclidean("v", F.reverse("v"))).alias("euclidean"))


@query("e3_score_table", f"WITH {SCORED} SELECT item_id, path, " + ", ".join(f"round({c}, 6) AS {c}" for c in sc.SCORE_COLUMNS) + " FROM scored")
def e3(t):
    return scored(t).select("item_id", "path", *[r6(c).alias(c) for c in sc.SCORE_COLUMNS])


@query("e3_score_by_cohort_model", f"WITH {ITEM_ROWS}, cen AS ({model('items', 'cohort,')}), s AS (SELECT items.*, {SCORE_EXPR} FROM items JOIN cen USING (cohort)) SELECT item_id, cohort, round((cosine_to_mean + cosine_to_median) / 2, 6) AS centroid_score, round(euclidean_to_mean, 6) AS euclidean_to_mean, round(euclidean_to_median, 6) AS euclidean_to_median FROM s")
def e3_by(t):
    rows = sc.score_items(items(t), cen.centroid_models(items(t), ["cohort"]), ["cohort"])
    return rows.select("item_id", "cohort", *[r6(c).alias(c) for c in ("centroid_score", "euclidean_to_mean", "euclidean_to_median")])


@query("e4_score_rank", f"WITH {SCORED} SELECT item_id, row_number() OVER (ORDER BY centroid_score DESC, path) AS rank, round(centroid_score, 6) AS centroid_score FROM scored")
def e4(t):
    return sc.rank_scores(scored(t)).select("item_id", "rank", r6("centroid_score").alias("centroid_score"))


@query("e5_score_summary", f"WITH {SCORED_WITH_FAILED} SELECT run, count(centroid_score) AS item_count, count(*) FILTER (centroid_score IS NULL) AS failed_count, arg_max(item_id, centroid_score) AS best_item_id, round(max(centroid_score), 6) AS best_centroid_score, round(avg(centroid_score), 6) AS mean_centroid_score, round(median(centroid_score), 6) AS median_centroid_score FROM scored GROUP BY run")
def e5(t):
    return sc.score_summary(scored_with_failed(t), ["run"])


@query("e5_score_top_rows", f"WITH {SCORED} SELECT item_id, path, round(centroid_score, 6) AS centroid_score FROM scored ORDER BY scored.centroid_score DESC, path LIMIT 5")
def e5_top(t):
    return sc.top_rows(scored(t)).select("item_id", "path", r6("centroid_score").alias("centroid_score"))


HALVES = f"{ITEM_ROWS}, halves AS (SELECT item_id, run, path, v[33:64] AS v FROM items), cen AS ({model('halves')}), styled AS (SELECT item_id, run, path, {inputs.cos('v', 'mean_v')} AS cm, {inputs.cos('v', 'med_v')} AS cd FROM halves, cen)"


def style_scores(t):
    """Second modality: the upper half of the vector, with its own centroid."""
    half = items(t).withColumn("embedding", F.slice("embedding", 33, 32))
    rows = sc.score_items(half, cen.centroid_models(half))
    return rows.select(
        "item_id", "run", "path", F.col("cosine_to_mean").alias("cosine_to_mean_style"),
        F.col("cosine_to_median").alias("cosine_to_median_style"), F.col("centroid_score").alias("style_score"),
    )


@query("e8_style_scores", f"WITH {HALVES} SELECT item_id, round(cm, 6) AS cosine_to_mean_style, round(cd, 6) AS cosine_to_median_style, round((cm + cd) / 2, 6) AS style_score FROM styled")
def e8(t):
    return style_scores(t).select("item_id", *[r6(c).alias(c) for c in ("cosine_to_mean_style", "cosine_to_median_style", "style_score")])


@query("e8_style_summary", f"WITH {HALVES} SELECT run, count(*) AS item_count, cast(0 AS bigint) AS failed_count, arg_max(item_id, (cm + cd) / 2) AS best_item_id, round(max((cm + cd) / 2), 6) AS best_style_score, round(avg((cm + cd) / 2), 6) AS mean_style_score, round(median((cm + cd) / 2), 6) AS median_style_score FROM styled GROUP BY run")
def e8_summary(t):
    return sc.score_summary(style_scores(t), ["run"], score="style_score")


REVIEW = f"""{SCORED_WITH_FAILED}, rv AS (SELECT r.subject, count(centroid_score) AS item_count, count(*) FILTER (path IS NOT NULL AND centroid_score IS NULL) AS failed_count,
  arg_max(item_id, centroid_score) AS best_item_id, arg_max(path, centroid_score) AS best_path, max(centroid_score) AS best_centroid_score, avg(centroid_score) AS mean_centroid_score,
  median(centroid_score) AS median_centroid_score, avg(cosine_to_mean) AS mean_cosine_to_mean, avg(cosine_to_median) AS mean_cosine_to_median
  FROM (SELECT 's' || cast(n_nationkey AS string) AS subject FROM nation) r LEFT JOIN scored USING (subject) GROUP BY ALL)"""
_REVIEW_ROUND = ["best_centroid_score", "mean_centroid_score", "median_centroid_score", "mean_cosine_to_mean", "mean_cosine_to_median"]


def reviews(t):
    return sc.subject_reviews(roster(t), scored_with_failed(t))


@query("e9_subject_reviews", f"WITH {REVIEW} SELECT subject, item_count, failed_count, best_item_id, best_path, " + ", ".join(f"round({c}, 6) AS {c}" for c in _REVIEW_ROUND) + ", row_number() OVER (ORDER BY coalesce(mean_centroid_score, -1) DESC, subject) AS position FROM rv")
def e9(t):
    placed = scale.row_numbers(reviews(t), [], sc.review_order(), "position")
    return placed.select("subject", "item_count", "failed_count", "best_item_id", "best_path", *[r6(c).alias(c) for c in _REVIEW_ROUND], "position")


@query("e10_top_items_per_subject", f"WITH {SCORED} SELECT * FROM (SELECT subject, item_id, round(centroid_score, 6) AS centroid_score, row_number() OVER (PARTITION BY subject ORDER BY scored.centroid_score DESC, path) AS rank FROM scored) WHERE rank <= 5")
def e10(t):
    return sc.top_items(scored(t), ["subject"]).select("subject", "item_id", r6("centroid_score").alias("centroid_score"), "rank")


@query("e11_leaderboards", f"""WITH {REVIEW}, long AS (SELECT subject, unnest({list(sc.LEADERBOARDS)}) AS board,
  unnest([mean_centroid_score, best_centroid_score, best_centroid_score - mean_centroid_score, mean_cosine_to_mean, mean_cosine_to_median]) AS metric FROM rv)
  SELECT subject, board, round(metric, 6) AS metric, rank FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY metric DESC, subject) AS rank FROM long WHERE metric IS NOT NULL) WHERE rank <= 5""")
def e11(t):
    return sc.leaderboards(reviews(t)).select("subject", "board", r6("metric").alias("metric"), "rank")


@query("e12_across_subjects", f"WITH {REVIEW} SELECT cast(sum(item_count) AS bigint) AS reviewed_count, cast(sum(failed_count) AS bigint) AS failed_count, round(avg(mean_centroid_score), 6) AS mean_of_subject_means, round(median(mean_centroid_score), 6) AS median_of_subject_means FROM rv")
def e12(t):
    return sc.across_subjects(reviews(t))


CHUNKED = f"""{SCORED_WITH_FAILED}, placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY path) AS rn, count(*) OVER (PARTITION BY run) AS n FROM scored),
chunked AS (SELECT *, cast(floor((rn - 1) / greatest(1, ceil(n / 4))) AS bigint) AS chunk FROM placed),
sums AS (SELECT run, chunk, count(centroid_score) AS item_count, count(*) FILTER (centroid_score IS NULL) AS failed_count, arg_max(item_id, centroid_score) AS best_item_id, max(centroid_score) AS best_centroid_score, min(path) AS first_path, max(path) AS last_path FROM chunked GROUP BY ALL)"""


def chunks(t):
    return sc.chunk_summaries(sc.chunk_assignment(scored_with_failed(t), 4, ["run"]), ["run"])


@query("e13_chunk_summaries", f"WITH {CHUNKED} SELECT run, chunk, item_count, failed_count, best_item_id, round(best_centroid_score, 6) AS best_centroid_score, first_path, last_path FROM sums")
def e13(t):
    return chunks(t).withColumn("best_centroid_score", r6("best_centroid_score"))


@query("e13_merged_chunks", f"WITH {CHUNKED} SELECT run, count(*) AS chunk_count, cast(sum(item_count) AS bigint) AS item_count, cast(sum(failed_count) AS bigint) AS failed_count, arg_max(best_item_id, best_centroid_score) AS best_item_id, round(max(best_centroid_score), 6) AS best_centroid_score FROM sums GROUP BY run")
def e13_merged(t):
    return sc.merged_summary(chunks(t), ["run"])


@query("a11_first_items_by_path", f"WITH {ITEM_ROWS} SELECT * FROM (SELECT subject, path, row_number() OVER (PARTITION BY subject ORDER BY path) AS rank FROM items) WHERE rank <= 3")
def a11(t):
    return scale.first_rows(items(t), ["subject"], [F.col("path")], 3, rank="rank").select("subject", "path", "rank")


@query("a12_quarantine", f"WITH {ITEM_ROWS}, bad AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY path) AS rn FROM items WHERE reason IS NOT NULL) SELECT run, count(*) AS failed_count, string_agg(path, ';' ORDER BY path) FILTER (rn <= 20) AS failed_paths FROM bad GROUP BY run")
def a12(t):
    return sc.failed_sample(items(t), ["run"]).withColumn("failed_paths", F.array_join("failed_paths", ";"))
