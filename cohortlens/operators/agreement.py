"""Agreement between encoders: ordinal-rank correlation over the items they share, and encoder run tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scale
from ..functions.numeric import r6
from .scoring import best_of


def moment_correlation(left: str, right: str) -> Column:
    """Correlation from mergeable moments; null if either side has no variance (``corr`` would divide by zero)."""
    spread = F.stddev_pop(left) * F.stddev_pop(right)
    return F.covar_pop(left, right) / F.when(spread >= 1e-12, spread)


def paired_scores(scores: DataFrame, encoders: list[str], key: str = "path", score: str = "score") -> DataFrame:
    """Rows (encoder_a, encoder_b, key, left, right) of the declared encoder pairs, for keys both encoders scored.

    One shuffle by key turns the long table into one row per key; the pairs are unfolded from that row, so the table is
    never joined with itself.
    """
    names = sorted(encoders)
    wide = scores.groupBy(key).agg(*[F.max(F.when(F.col("encoder") == e, F.col(score))).alias(f"s_{i}") for i, e in enumerate(names)])
    pairs = [
        F.struct(F.lit(names[i]).alias("encoder_a"), F.lit(names[j]).alias("encoder_b"), F.col(f"s_{i}").alias("left"), F.col(f"s_{j}").alias("right"))
        for i, j in combinations(range(len(names)), 2)
    ]
    rows = wide.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*")
    return rows.where(F.col("left").isNotNull() & F.col("right").isNotNull())


def rank_agreement(scores: DataFrame, encoders: list[str], key: str = "path", score: str = "score") -> DataFrame:
    """Spearman over ordinal ranks (ties in key order) of every encoder pair; null below two common keys."""
    pair = ["encoder_a", "encoder_b"]
    rows = scale.settle(paired_scores(scores, encoders, key, score))
    ranked = scale.row_numbers(rows, pair, [F.col("left"), F.col(key)], "rank_a")
    ranked = scale.row_numbers(ranked, pair, [F.col("right"), F.col(key)], "rank_b")
    measured = ranked.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("common_count"), r6(moment_correlation("rank_a", "rank_b")).alias("spearman_rank")
    )
    declared = scores.sparkSession.createDataFrame(list(combinations(sorted(encoders), 2)), "encoder_a string, encoder_b string")
    return declared.join(measured, pair, "left").withColumn("common_count", F.coalesce("common_count", F.lit(0)))


def subject_scores(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean score per encoder and subject, as the long table ``rank_agreement`` takes."""
    return scores.groupBy("encoder", "subject").agg(F.avg(score).alias(score))


def encoder_runs(declared: DataFrame, references: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per declared encoder: accepted and failed on both sides, width, best item, mean score.

    ``references`` (encoder, width) and ``scores`` (encoder, item_id, path, score) keep failed items as null width or
    score.  An encoder without any usable reference is a ``failed`` row.
    """
    refs = references.groupBy("encoder").agg(
        F.count("width").alias("reference_count"),
        F.count_if(F.col("width").isNull()).alias("reference_failed_count"),
        F.max("width").alias("embedding_dim"),
    )
    scored = scores.groupBy("encoder").agg(
        F.count("score").alias("item_count"),
        F.count_if(F.col("score").isNull()).alias("failed_count"),
        best_of("item_id", "score", "path").alias("best_item_id"),
        r6(F.max("score")).alias("best_score"),
        r6(F.avg("score")).alias("mean_score"),
    )
    joined = declared.join(refs, "encoder", "left").join(scored, "encoder", "left")
    done = F.coalesce(F.col("reference_count") > 0, F.lit(False))
    zero = ["reference_count", "reference_failed_count", "item_count", "failed_count"]
    kept = ["embedding_dim", "best_item_id", "best_score", "mean_score"]
    return joined.select(
        "encoder",
        F.when(done, "completed").otherwise("failed").alias("status"),
        *[F.when(done, F.coalesce(F.col(c), F.lit(0))).otherwise(0).alias(c) for c in zero],
        *[F.when(done, F.col(c)).alias(c) for c in kept],
    )


def encoder_summary(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Completed and failed counts and names; the lists hold declared encoder names only."""
    def names(status: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("status") == status, F.col("encoder"))))

    return runs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(F.col("status") == "completed").alias("completed_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        names("completed").alias("completed_encoders"),
        names("failed").alias("failed_encoders"),
    )
