"""Queries: encoder agreement and score-engagement correlation."""

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import agreement as agr
from ..operators import centroids as cen
from ..operators import correlation as cor
from ..operators import scoring as sc
from .engagement_queries import ENG, engagement
from .inputs import ITEM_ROWS, SCORED, SCORE_EXPR, model
from .registry import query
from .score_queries import scored
from .vector_queries import items

# Three encoders, each reading its own 32 positions; encoder a cannot read some items; encoder z is declared but has no rows.
WINDOWS = {"a": 1, "b": 33, "c": 17}
ENCODERS = [*WINDOWS, "z"]
ENCODED = f"""{ITEM_ROWS}, enc AS ({' UNION ALL '.join(f"SELECT '{e}' AS encoder, item_id, subject, path, CASE WHEN '{e}' = 'a' AND reason IS NOT NULL THEN NULL ELSE v[{s}:{s + 31}] END AS v FROM items" for e, s in WINDOWS.items())}),
good AS (SELECT * FROM enc WHERE v IS NOT NULL), cen AS ({model('good', 'encoder,')}),
es AS (SELECT encoder, item_id, subject, path, (cosine_to_mean + cosine_to_median) / 2 AS score FROM (SELECT good.*, {SCORE_EXPR} FROM good JOIN cen USING (encoder)))"""
RANKED = """SELECT encoder_a, encoder_b, common_count, round(rho, 6) AS spearman_rank FROM (SELECT encoder_a, encoder_b, count(*) AS common_count, corr(ra, rb) AS rho FROM (
  SELECT *, row_number() OVER (PARTITION BY encoder_a, encoder_b ORDER BY a, k) AS ra, row_number() OVER (PARTITION BY encoder_a, encoder_b ORDER BY b, k) AS rb FROM (
    SELECT l.encoder AS encoder_a, r.encoder AS encoder_b, l.{k} AS k, l.score AS a, r.score AS b FROM {src} l JOIN {src} r ON l.{k} = r.{k} AND l.encoder < r.encoder)) GROUP BY ALL)
UNION ALL SELECT encoder, 'z', cast(0 AS bigint), NULL FROM (SELECT DISTINCT encoder FROM {src})"""


def encoded(t):
    def part(encoder, start):
        values = F.slice("embedding", start, 32)
        return F.struct(F.lit(encoder).alias("encoder"), (F.when(F.col("reason").isNull(), values) if encoder == "a" else values).alias("embedding"))

    return items(t).select("item_id", "subject", "path", F.explode(F.array(*[part(e, s) for e, s in WINDOWS.items()])).alias("e")).select(
        "item_id", "subject", "path", "e.*"
    )


def encoder_scores(t):
    good = encoded(t).where(F.col("embedding").isNotNull())
    rows = sc.score_items(good, cen.centroid_models(good, ["encoder"]), ["encoder"])
    return rows.select("encoder", "item_id", "subject", "path", F.col("centroid_score").alias("score"))


@query("l1_rank_agreement", f"WITH {ENCODED} " + RANKED.format(k="path", src="es"))
def l1(t):
    return agr.rank_agreement(encoder_scores(t), ENCODERS)


@query("l2_subject_rank_agreement", f"WITH {ENCODED}, ss AS (SELECT encoder, subject, avg(score) AS score FROM es GROUP BY ALL) " + RANKED.format(k="subject", src="ss"))
def l2(t):
    return agr.rank_agreement(agr.subject_scores(encoder_scores(t)), ENCODERS, key="subject")


RUNS = f"""{ENCODED}, decl AS (SELECT unnest({ENCODERS!r}) AS encoder), rf AS (SELECT encoder, count(v) AS rc, count(*) FILTER (v IS NULL) AS rfc, max(len(v)) AS dim FROM enc GROUP BY ALL),
sco AS (SELECT enc.encoder, count(score) AS ic, count(*) FILTER (score IS NULL) AS fc, arg_max(enc.item_id, score) AS best, round(max(score), 6) AS best_score, round(avg(score), 6) AS mean_score FROM enc LEFT JOIN es USING (encoder, item_id) GROUP BY ALL),
runs AS (SELECT encoder, CASE WHEN rc > 0 THEN 'completed' ELSE 'failed' END AS status, coalesce(rc, 0) AS reference_count, coalesce(rfc, 0) AS reference_failed_count, coalesce(ic, 0) AS item_count, coalesce(fc, 0) AS failed_count, dim AS embedding_dim, best AS best_item_id, best_score, mean_score FROM decl LEFT JOIN rf USING (encoder) LEFT JOIN sco USING (encoder))"""


def encoder_runs(t):
    rows = encoded(t)
    declared = rows.sparkSession.createDataFrame([(e,) for e in ENCODERS], "encoder string")
    references = rows.select("encoder", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("width"))
    scores = encoder_scores(t).select("encoder", "item_id", "score")
    return agr.encoder_runs(declared, references, rows.select("encoder", "item_id", "path").join(scores, ["encoder", "item_id"], "left"))


@query("l3_encoder_runs", f"WITH {RUNS} SELECT * FROM runs")
def l3(t):
    return encoder_runs(t)


@query("l4_encoder_summary", f"WITH {RUNS} SELECT count(*) AS run_count, count(*) FILTER (status = 'completed') AS completed_count, count(*) FILTER (status = 'failed') AS failed_count, string_agg(encoder, ';' ORDER BY encoder) FILTER (status = 'completed') AS completed_encoders, string_agg(encoder, ';' ORDER BY encoder) FILTER (status = 'failed') AS failed_encoders FROM runs")
def l4(t):
    names = {c: F.array_join(c, ";") for c in ("completed_encoders", "failed_encoders")}
    return agr.encoder_summary(encoder_runs(t)).withColumns(names)


CHANNELS = {"instagram": "ig", "twitter": "tw", "tiktok": "tk"}
SCORE_COLUMNS = ["mean_centroid_score", "best_centroid_score"]
METRIC_COLUMNS = [
    "ig_followers", "ig_total_engagement", "ig_engagement_rate", "tw_followers", "tk_followers", "tk_total_engagement",
    "tk_engagement_rate", "total_followers", "max_followers",
]
_WIDE = ", ".join(f"max({m}) FILTER (channel = '{c}') AS {p}_{m}" for c, p in CHANNELS.items() for m in cor.METRICS)
DATASET = f"""{SCORED}, {ENG}, subj AS (SELECT 'u' || cast(item_id % 170 AS string) AS subject, avg(centroid_score) AS mean_centroid_score, max(centroid_score) AS best_centroid_score, count(*) AS item_count FROM scored GROUP BY ALL),
wide AS (SELECT subject, max(name) AS name, {_WIDE} FROM eng GROUP BY subject),
ds AS (SELECT coalesce(s.subject, w.subject) AS subject, coalesce(w.name, s.subject) AS name, s.* EXCLUDE (subject), w.* EXCLUDE (subject, name),
  CASE WHEN coalesce(ig_followers, tw_followers, tk_followers) IS NOT NULL THEN coalesce(ig_followers, 0) + coalesce(tw_followers, 0) + coalesce(tk_followers, 0) END AS total_followers, greatest(ig_followers, tw_followers, tk_followers) AS max_followers FROM subj s FULL JOIN wide w ON s.subject = w.subject)"""


def subject_scores(t):
    rows = scored(t).groupBy(F.concat(F.lit("u"), F.col("item_id") % 170).alias("subject"))
    return rows.agg(
        F.avg("centroid_score").alias("mean_centroid_score"), F.max("centroid_score").alias("best_centroid_score"), F.count(F.lit(1)).alias("item_count")
    )


def dataset(t):
    wide = cor.channel_columns(engagement(t), CHANNELS, "seq")
    return cor.correlation_dataset(subject_scores(t), wide, list(CHANNELS.values()))


@query("m1_channel_columns", f"WITH {ENG} SELECT subject, max(name) AS name, {_WIDE} FROM eng GROUP BY subject")
def m1(t):
    return cor.channel_columns(engagement(t), CHANNELS, "seq")


@query("m2_scores_with_engagement", f"WITH {DATASET} SELECT subject, name, item_count, round(mean_centroid_score, 6) AS mean_centroid_score, ig_followers, tk_engagement_rate FROM ds")
def m2(t):
    return dataset(t).select("subject", "name", "item_count", r6("mean_centroid_score").alias("mean_centroid_score"), "ig_followers", "tk_engagement_rate")


@query("m3_follower_totals", f"WITH {DATASET} SELECT subject, total_followers, max_followers FROM ds")
def m3(t):
    return dataset(t).select("subject", "total_followers", "max_followers")


_PAIRS_SQL = " UNION ALL ".join(f"SELECT '{s}' AS variable_a, '{m}' AS variable_b, subject, cast({s} AS double) AS a, cast({m} AS double) AS b FROM ds" for s in SCORE_COLUMNS for m in METRIC_COLUMNS)
PAIRS = f"{DATASET}, pr AS (SELECT * FROM ({_PAIRS_SQL}) WHERE a IS NOT NULL AND b IS NOT NULL)"
RHO = f"{PAIRS}, rk AS (SELECT *, rank() OVER (PARTITION BY variable_a, variable_b ORDER BY a) + (count(*) OVER (PARTITION BY variable_a, variable_b, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY variable_a, variable_b ORDER BY b) + (count(*) OVER (PARTITION BY variable_a, variable_b, b) - 1) / 2 AS rb FROM pr), cr AS (SELECT variable_a, variable_b, count(*) AS n, corr(a, b) AS pearson_r, corr(ra, rb) AS spearman_r FROM rk GROUP BY ALL)"


@query("m4_pearson", f"WITH {PAIRS} SELECT variable_a, variable_b, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(a, b), 4) END AS pearson_r FROM pr GROUP BY ALL")
def m4(t):
    return cor.correlations(dataset(t), SCORE_COLUMNS, METRIC_COLUMNS, spearman=False).withColumn("pearson_r", F.round("pearson_r", 4))


@query("m5_spearman", f"WITH {RHO} SELECT variable_a, variable_b, n, round(spearman_r, 4) AS spearman_r FROM cr")
def m5(t):
    return cor.correlations(dataset(t), SCORE_COLUMNS, METRIC_COLUMNS).select("variable_a", "variable_b", "n", F.round("spearman_r", 4).alias("spearman_r"))


LABEL = "CASE WHEN abs({r}) >= 0.7 THEN 'strong' WHEN abs({r}) >= 0.4 THEN 'moderate' WHEN abs({r}) >= 0.2 THEN 'weak' ELSE 'negligible' END || CASE WHEN {r} >= 0 THEN '_positive' ELSE '_negative' END"


# Two-sided p of a correlation r over n rows: the share of cos^(n-3) beyond the angle asin|r|, by the midpoint rule.
_AT = "asin(least(1, abs({r})))"
_P = f"""CASE WHEN n >= 3 THEN list_sum(list_transform(range(4000), lambda i: cos({_AT} + (i + 0.5) * (pi() / 2 - {_AT}) / 4000) ** (n - 3))) * (pi() / 2 - {_AT}) / 4000
  / (sqrt(pi()) / 2 * exp(lgamma((n - 2) / 2) - lgamma((n - 1) / 2))) END"""


@query("m6_correlation_report", f"""WITH {RHO}, big AS (SELECT variable_a, variable_b, n, CASE WHEN n >= 3 THEN pearson_r END AS pearson_r, CASE WHEN n >= 3 THEN spearman_r END AS spearman_r FROM cr),
  t AS (SELECT *, {_P.format(r='pearson_r')} AS pearson_p, {_P.format(r='spearman_r')} AS spearman_p FROM big)
  SELECT variable_a, variable_b, n, round(pearson_r, 4) AS pearson_r, round(spearman_r, 4) AS spearman_r, round(pearson_p, 4) AS pearson_p, round(spearman_p, 4) AS spearman_p,
    CASE WHEN n < 3 THEN 'insufficient_data' WHEN spearman_r IS NULL THEN 'no_data' ELSE {LABEL.format(r='spearman_r')} || CASE WHEN spearman_p < 0.05 THEN '*' WHEN spearman_p < 0.1 THEN '+' ELSE '' END END AS interpretation FROM t""")
def m6(t):
    return cor.correlation_report(cor.correlations(dataset(t), SCORE_COLUMNS, METRIC_COLUMNS))


@query("m7_interpretation", f"WITH {ITEM_ROWS} SELECT item_id, CASE WHEN item_id % 10 = 0 THEN 'no_data' WHEN item_id % 7 < 3 THEN 'insufficient_data' ELSE {LABEL.format(r='(v[1] * 4)')} || CASE WHEN abs(v[2]) < 0.05 THEN '*' WHEN abs(v[2]) < 0.1 THEN '+' ELSE '' END END AS interpretation FROM items WHERE NOT (item_id % 10 = 0 AND item_id % 7 < 3) UNION ALL SELECT item_id, 'insufficient_data' FROM items WHERE item_id % 10 = 0 AND item_id % 7 < 3")
def m7(t):
    df = t.sql("SELECT vec_id AS item_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE embedding@1 * 4 END AS r, abs(embedding@2) AS p, vec_id % 7 AS n FROM {embeddings}")
    return df.select("item_id", cor.interpretation(F.col("r"), F.col("p"), F.col("n")).alias("interpretation"))


@query("m8_dataset_coverage", f"WITH {DATASET} SELECT count(*) AS subject_count, count(mean_centroid_score) AS with_score, count(ig_followers) AS with_ig, count(tw_followers) AS with_tw, count(tk_followers) AS with_tk FROM ds")
def m8(t):
    return cor.dataset_coverage(dataset(t), {"with_score": "mean_centroid_score", "with_ig": "ig_followers", "with_tw": "tw_followers", "with_tk": "tk_followers"})


@query("m8_score_ranking", f"WITH {DATASET} SELECT subject, row_number() OVER (ORDER BY coalesce(mean_centroid_score, 0) DESC, subject) AS position FROM ds")
def m8_ranking(t):
    return cor.score_ranking(dataset(t), "mean_centroid_score").select("subject", "position")


@query("m8_strongest_pairs", f"WITH {RHO} SELECT variable_a, variable_b, row_number() OVER (ORDER BY coalesce(abs(round(spearman_r, 8)), 0) DESC, variable_a, variable_b) AS position FROM cr")
def m8_pairs(t):
    result = cor.correlations(dataset(t), SCORE_COLUMNS, METRIC_COLUMNS)
    return cor.strongest_first(result.withColumn("spearman_r", F.round("spearman_r", 8))).select("variable_a", "variable_b", "position")


@query("r3_top_correlation", f"WITH {RHO}, c AS (SELECT *, CASE WHEN variable_b LIKE 'ig%' THEN NULL ELSE round(spearman_r, 6) END AS rho FROM cr) SELECT count(*) AS correlation_count, (SELECT variable_a FROM c WHERE rho IS NOT NULL ORDER BY abs(rho) DESC, variable_a, variable_b LIMIT 1) AS top_variable_a, (SELECT variable_b FROM c WHERE rho IS NOT NULL ORDER BY abs(rho) DESC, variable_a, variable_b LIMIT 1) AS top_variable_b, (SELECT n FROM c WHERE rho IS NOT NULL ORDER BY abs(rho) DESC, variable_a, variable_b LIMIT 1) AS top_n, (SELECT rho FROM c WHERE rho IS NOT NULL ORDER BY abs(rho) DESC, variable_a, variable_b LIMIT 1) AS top_spearman_r FROM c")
def r3(t):
    """Some correlations are NaN: they must never win and never be emitted."""
    result = cor.correlations(dataset(t), SCORE_COLUMNS, METRIC_COLUMNS)
    nan = F.when(F.col("variable_b").startswith("ig"), F.lit(float("nan"))).otherwise(r6("spearman_r"))
    return cor.top_pair(result.withColumn("spearman_r", nan))
