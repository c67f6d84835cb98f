"""Strict review of a batch's top candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import labels, pick, r6

# Fixed values.
SEVERE_FLAGS = ["dark_or_underlit_image", "off_center_or_asymmetric_visibility", "high_texture_or_messy_edges"]
MIN_SCORE, MIN_NULL_PERCENTILE, MIN_GAP = 0.35, 0.95, 0.05
TOP_LIST = 5  # candidates come from a summary's top list


def batch_null_review(
    batches: DataFrame, percentile: str = "best_percentile", minimum: float = MIN_NULL_PERCENTILE, available: str | None = None
) -> DataFrame:
    """Whether the best score clears the null baseline; unknown without a calibration.

    ``available`` names the column that tells whether there is one; then a missing percentile counts as 0 and fails.
    Without it a percentile is what tells.
    """
    there = F.coalesce(F.col(available), F.lit(False)) if available else F.col(percentile).isNotNull()
    value = F.when(there, F.coalesce(percentile, F.lit(0.0)))
    return batches.withColumns(
        {
            "null_available": there,
            "null_pass": value >= minimum,
            "null_reason": pick(
                (value.isNull(), "null calibration unavailable"), (value >= minimum, "best centroid score clears null baseline"),
                otherwise="best centroid score is not sufficiently above null baseline",
            ),
        }
    )


def candidate_reviews(candidates: DataFrame, quality: DataFrame, axes: DataFrame, keys: list[str], minimum: float = MIN_SCORE) -> DataFrame:
    """Three-valued checks per candidate: any failed one rejects, else any unknown one asks for review, else promote.

    A check is unknown where its row is missing, or where the gate row has no result; an axes row without a flag list has
    no flags.  The reason is the gate row's own, null included.
    """
    gate = quality.select(*keys, "qa_pass", F.col("reason").alias("quality_reason"), F.lit(True).alias("__gated"))
    flags = axes.select(*keys, "presentation_flags", F.lit(True).alias("__seen"))
    joined = candidates.join(gate, keys, "left").join(flags, keys, "left")
    severe = F.array_sort(F.array_intersect(F.coalesce("presentation_flags", F.array().cast("array<string>")), F.array(*map(F.lit, SEVERE_FLAGS))))
    checked = joined.withColumns(
        {
            "score_pass": F.coalesce("centroid_score", F.lit(0.0)) >= minimum,
            "quality_reason": F.when(F.col("__gated").isNull(), "quality report unavailable").otherwise(F.col("quality_reason")),
            "severe_flags": severe,
            "presentation_pass": F.when(F.col("__seen"), F.size(severe) == 0),
        }
    )
    names = {"centroid_score": "score_pass", "quality": "qa_pass", "presentation": "presentation_pass"}
    failed = labels(*[(F.col(c) == F.lit(False), n) for n, c in names.items()])
    unknown = F.col("qa_pass").isNull() | F.col("presentation_pass").isNull()
    return checked.drop("__gated", "__seen").withColumn("failed_checks", failed).withColumn(
        "recommendation", pick((F.size("failed_checks") > 0, "reject"), (unknown, "review"), otherwise="promote")
    )


def pairwise_comparisons(candidates: DataFrame, batch: list[str], minimum: float = MIN_GAP, top: int = TOP_LIST) -> DataFrame:
    """Winner and loser of every pair in a batch's top list (``rank`` at most ``top``, so at most top*(top-1)/2 pairs).

    The list is packed once per batch and the pairs are unfolded from it; the table is not joined with itself.
    """
    listed = candidates.where(F.col("rank") <= top)
    packed = listed.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "centroid_score"))).alias("c"))
    pairs = F.flatten(
        F.transform("c", lambda w, i: F.transform(F.slice("c", i + 2, F.lit(top)), lambda l: F.struct(w.alias("w"), l.alias("l"))))
    )
    rows = packed.select(*batch, F.explode(pairs).alias("p"))
    gap = F.col("p.w.centroid_score") - F.col("p.l.centroid_score")
    return rows.select(
        *batch, F.col("p.w.item_id").alias("winner"), F.col("p.l.item_id").alias("loser"), r6(gap).alias("centroid_gap"),
        F.when(gap >= minimum, "clear_win").otherwise("too_close").alias("decision"),
    )


def batch_decisions(batches: DataFrame, reviews: DataFrame, batch: list[str]) -> DataFrame:
    """Decision per batch from its best candidate and the null review."""
    best = reviews.groupBy(*batch).agg(
        F.min_by("item_id", "rank").alias("item_id"), F.min_by("recommendation", "rank").alias("__best")
    )
    joined = batches.join(best, batch, "left")
    none, blocked = F.col("__best").isNull(), F.col("null_pass") == F.lit(False)
    return joined.withColumns(
        {
            "decision": pick((none, "reject"), (blocked, "review"), otherwise=F.col("__best")),
            "decision_reason": pick(
                (none, "no candidates"), (blocked, "batch null calibration did not clear strict threshold"),
                otherwise="best candidate strict rubric result",
            ),
        }
    ).drop("__best")
