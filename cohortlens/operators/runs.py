"""Generation-run reviews: joins by path key, best items, candidate tables and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scale
from ..functions.numeric import pick, r6
from .scoring import best_of


def normal_path(path: Column) -> Column:
    """Absolute path with ``.``, ``..`` and repeated slashes resolved, in lower case."""
    empty = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(path, "/"),
        empty,
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.lower(F.concat(F.lit("/"), F.array_join(parts, "/")))


def path_keys(path: Column, bases: Column) -> Column:
    """Keys a path may be known by: itself if absolute, else resolved against every base folder."""
    absolute = F.array(normal_path(path))
    resolved = F.transform(bases, lambda base: normal_path(F.concat_ws("/", base, path)))
    return F.when(path.startswith("/"), absolute).otherwise(F.array_sort(F.array_distinct(resolved)))


def with_keys(df: DataFrame, bases: Column, path: str = "path", name: str = "path_key") -> DataFrame:
    """One row per path key."""
    return df.withColumn(name, F.explode(path_keys(F.col(path), bases)))


def smallest_key(keyed: DataFrame) -> DataFrame:
    """One row per item again: its smallest path key."""
    return keyed.groupBy(*[c for c in keyed.columns if c != "path_key"]).agg(F.min("path_key").alias("path_key"))


def first_match(rows: DataFrame, other: DataFrame, by: list[str], fields: list[str], name: str) -> DataFrame:
    """Every item of ``rows`` once, with its smallest path key and the ``fields`` of ``other`` under the smallest key both have.

    Both sides have a row per key.  An item is told by its run, id and path; of several rows under one key of ``other`` the
    smallest counts.
    """
    keys = [*by, "path_key"]
    lookup = other.groupBy(*keys).agg(F.min(F.struct(*fields)).alias(name))
    items = [c for c in rows.columns if c != "path_key"]
    found = F.min_by(name, F.when(F.col(name).isNotNull(), F.col("path_key")))
    return rows.join(lookup, keys, "left").groupBy(*items).agg(F.min("path_key").alias("path_key"), found.alias(name))


def best_quality(scores: DataFrame, quality: DataFrame, by: list[str], score: str = "centroid_score") -> DataFrame:
    """Best score among items that passed the gate, matched by path key; equal scores go to the smallest key."""
    scored = scores.where(F.col(score).isNotNull()).select(*by, "item_id", "path", "path_key", score)
    kept = first_match(scored, quality, by, ["qa_pass"], "__gate").where("__gate.qa_pass")
    return kept.groupBy(*by).agg(
        best_of("item_id", score, "path_key").alias("best_qa_item_id"),
        best_of("path", score, "path_key").alias("best_qa_path"),
        F.max(score).alias("best_qa_score"),
    )


def best_combined(scores: DataFrame, styles: DataFrame, by: list[str]) -> DataFrame:
    """Best mean of the two modalities per run, joined by path key (never by item id)."""
    scored = scores.where(F.col("centroid_score").isNotNull()).select(*by, "item_id", "path", "path_key", "centroid_score")
    both = first_match(scored, styles.where(F.col("style_score").isNotNull()), by, ["style_score"], "__style").where("__style is not null")
    combined = both.withColumn("combined", (F.col("centroid_score") + F.col("__style.style_score")) / 2.0)
    return combined.groupBy(*by).agg(
        best_of("item_id", "combined", "path_key").alias("best_combined_item_id"),
        best_of("path", "combined", "path_key").alias("best_combined_path"),
        F.max("combined").alias("best_combined_score"),
    )


def candidate_table(scores: DataFrame, styles: DataFrame, quality: DataFrame, by: list[str]) -> DataFrame:
    """Every item either modality scored, once, with its gate result; ``combined_score`` only where both scores exist.

    An item may be known by several path keys: the smallest key that both sides have decides.  A style row is a candidate
    of its own only if none of its keys belongs to an item that found its style.
    """
    keys = [*by, "path_key"]
    identity = [*by, "item_id", "path"]
    left = scores.select(*keys, "item_id", "path", "centroid_score")
    right = styles.select(*keys, "item_id", "path", "style_score")
    gate = quality.select(*keys, "qa_pass", F.col("reason").alias("qa_reason"))
    matched = first_match(left, right, by, ["style_score"], "__style")
    with_style = matched.where("__style is not null").select(*identity)
    consumed = scale.null_safe_keys(left.select(*keys, "item_id", "path"), with_style.withColumn("__hit", F.lit(True)), identity)
    consumed = consumed.where("__hit").select(*keys).distinct()
    used = right.join(consumed, keys, "left_semi").select(*identity).distinct().withColumn("__used", F.lit(True))
    alone = scale.null_safe_keys(right, used, identity).where("__used is null").drop("__used")
    gated_left = first_match(left, gate, by, ["qa_pass", "qa_reason"], "__gate").select(*identity, "__gate")
    rows = scale.null_safe_keys(matched, gated_left, identity).select(
        *keys, "item_id", "path", "centroid_score", F.col("__style.style_score").alias("style_score"), "__gate"
    )
    style_only = first_match(alone, gate, by, ["qa_pass", "qa_reason"], "__gate").select(
        *keys, "item_id", "path", F.lit(None).cast("double").alias("centroid_score"), "style_score", "__gate"
    )
    return rows.unionByName(style_only).select(
        *keys, "item_id", "path", "centroid_score", "style_score",
        ((F.col("centroid_score") + F.col("style_score")) / 2.0).alias("combined_score"),
        F.col("__gate.qa_pass").alias("qa_pass"), F.col("__gate.qa_reason").alias("qa_reason"),
    )


def candidate_tier() -> tuple[Column, Column]:
    """(tier, score): gate-passed 3, combined 2, single score 1, none 0."""
    passed = F.coalesce(F.col("qa_pass"), F.lit(False)) & F.col("centroid_score").isNotNull()
    single = F.coalesce("centroid_score", "style_score")
    tier = pick((passed, 3), (F.col("combined_score").isNotNull(), 2), (single.isNotNull(), 1), otherwise=0)
    value = pick((passed, F.col("centroid_score")), (F.col("combined_score").isNotNull(), F.col("combined_score")), otherwise=F.coalesce(single, F.lit(0.0)))
    return tier, value


def rank_candidates(candidates: DataFrame, by: list[str]) -> DataFrame:
    tier, value = candidate_tier()
    placed = candidates.withColumns({"tier": tier, "tier_score": value})
    return scale.row_numbers(placed, by, [F.col("tier").desc(), F.col("tier_score").desc(), F.col("path_key").asc()], "position")


def run_tier() -> tuple[Column, Column]:
    """(tier, score) of a run: gate-passed best 2, combined or plain best 1, none 0."""
    single = F.coalesce("best_combined_score", "best_centroid_score")
    tier = pick((F.col("best_qa_score").isNotNull(), 2), (single.isNotNull(), 1), otherwise=0)
    return tier, F.coalesce("best_qa_score", single, F.lit(0.0))


def review_runs(config: DataFrame, summary: DataFrame, styles: DataFrame, quality: DataFrame, combined: DataFrame, best_qa: DataFrame) -> DataFrame:
    """One row per evaluated run: config, both modality summaries, gate summary and bests; missing parts stay null."""
    rows = summary
    for side in (config, styles, quality, combined, best_qa):
        rows = rows.join(side, "run", "left")
    text = F.trim("prompt")
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    named = {c: F.coalesce(c, F.lit("")) for c in ("provider", "centroid_kind")}
    return rows.withColumns({**named, "prompt_words": F.when(F.col("prompt").isNotNull(), words), "size": F.coalesce(size, F.lit(""))})


def rank_runs(reviews: DataFrame) -> DataFrame:
    tier, value = run_tier()
    placed = reviews.withColumns({"tier": tier, "tier_score": value})
    return scale.row_numbers(placed, [], [F.col("tier").desc(), F.col("tier_score").desc(), F.col("run").asc()], "position")


def kind_rollup(reviews: DataFrame) -> DataFrame:
    """Runs by centroid kind: counts, the best of each score with its item, and null-aware sums."""
    tier, value = run_tier()
    kind = F.coalesce(F.nullif("centroid_kind", F.lit("")), F.lit("unknown"))
    placed = reviews.withColumns({"centroid_kind": kind, "__tier": tier, "__value": value})
    first = F.struct((-F.col("__tier")).alias("t"), (-F.col("__value")).alias("v"), F.col("run").alias("r"))
    return placed.groupBy("centroid_kind").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.min_by("run", F.when(F.col("__tier") > 0, first)).alias("best_run"),
        r6(F.max("best_centroid_score")).alias("best_centroid_score"),
        r6(F.max("best_qa_score")).alias("best_qa_score"),
        r6(F.max("best_combined_score")).alias("best_combined_score"),
        best_of("best_item_id", "best_centroid_score", "run").alias("best_item_id"),
        best_of("best_qa_item_id", "best_qa_score", "run").alias("best_qa_item_id"),
        best_of("best_combined_item_id", "best_combined_score", "run").alias("best_combined_item_id"),
        F.sum("pass_count").alias("qa_pass_count"),
        F.sum("item_count").alias("item_count"),
        F.sum("failed_count").alias("failed_count"),
    )


def best_item_components(runs: DataFrame, top: DataFrame, scores: DataFrame, ids: list[str], parts: list[str]) -> DataFrame:
    """Score parts of each run's best item.

    The id is the first of ``ids`` present.  Its parts come from the run's top list, else from its full scores, and never
    from another item; only a run without any id takes its top item.
    """
    chosen = runs.withColumn("best_id", F.coalesce(*ids))
    order = F.struct((-F.col("centroid_score")).alias("s"), F.col("path").alias("p"))
    packed = F.struct("path", *parts)

    def by_item(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("run", F.col("item_id").alias("best_id")).agg(F.min_by(packed, order).alias(name))

    leader = top.groupBy("run").agg(F.min_by(packed, order).alias("__leader"))
    joined = chosen.join(by_item(top, "__top"), ["run", "best_id"], "left").join(by_item(scores, "__all"), ["run", "best_id"], "left")
    found = F.when(F.col("best_id").isNull(), F.col("__leader")).otherwise(F.coalesce("__top", "__all"))
    rows = joined.join(leader, "run", "left").withColumn("__found", found)
    return rows.select(*chosen.columns, F.col("__found.path").alias("best_path"), *[F.col(f"__found.{p}").alias(f"best_{p}") for p in parts])
