"""Data-quality audit: balance, exact duplicates, size outliers, cohort evidence, issues and backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scale
from ..functions.numeric import labels, pick
from .scoring import attach


def subject_balance(roster: DataFrame, items: DataFrame, by: list[str], subject: str = "subject") -> DataFrame:
    """Subjects (empty ones included), items, min / max / mean per subject and max / max(1, min)."""
    counts = items.groupBy(*by, subject).agg(F.count(F.lit(1)).alias("n"))
    full = roster.select(*by, subject).distinct().join(counts, [*by, subject], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.groupBy(*by).agg(
        F.count(F.lit(1)).alias("subject_count"),
        F.sum("n").alias("item_count"),
        F.min("n").alias("min_items"),
        F.max("n").alias("max_items"),
        F.round(F.avg("n"), 3).alias("mean_items"),
        F.round(F.max("n") / F.greatest(F.lit(1), F.min("n")), 3).alias("imbalance_ratio"),
        F.count_if(F.col("n") == 0).alias("empty_subjects"),
    )


def content_digests(items: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Only the keys and a 64-character digest travel further; the content itself never enters a shuffle.

    ``settle`` the result where it is used twice, so that the content is read and hashed once.
    """
    return items.select(*keys, F.sha2(F.col(content).cast("binary"), 256).alias("digest"))


def duplicate_groups(digests: DataFrame, by: list[str], item: str) -> DataFrame:
    """Contents held by more than one item: size and first item per digest (counted map-side, no member lists)."""
    return (
        digests.groupBy(*by, "digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(item).alias("first_item"))
        .where(F.col("copies") > 1)
    )


def duplicate_members(digests: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Every member row of every duplicate group, in long form, so a huge group stays spread over tasks."""
    return digests.join(groups.select(*by, "digest", "copies", "first_item"), [*by, "digest"])


def duplicate_totals(groups: DataFrame, by: list[str]) -> DataFrame:
    return groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("duplicate_group_count"), F.sum("copies").alias("duplicate_item_count")
    )


def first_duplicate_groups(groups: DataFrame, limit: int = 25) -> DataFrame:
    """The report's first groups in digest order."""
    return groups.orderBy("digest").limit(limit)


def size_flags() -> dict[str, Column]:
    """Small (short side below 384) and aspect outlier (below .55 or above 1.9); null sizes are unreadable items."""
    ratio = F.when(F.col("height") != 0, F.col("width") / F.nullif(F.col("height"), F.lit(0))).otherwise(0.0)
    return {
        "unreadable": F.col("width").isNull() | F.col("height").isNull(),
        "small": F.least("width", "height") < 384,
        "aspect_outlier": (ratio < 0.55) | (ratio > 1.9),
    }


def size_audit(items: DataFrame, by: list[str], limit: int = 25) -> DataFrame:
    """Counts of unreadable, small and aspect-outlier items per group with the report's first ``limit`` paths of each."""
    flagged = items.withColumns(size_flags())
    readable = ~F.col("unreadable")
    counts = flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if("unreadable").alias("unreadable_count"),
        F.count_if(readable & F.col("small")).alias("small_count"),
        F.count_if(readable & F.col("aspect_outlier")).alias("aspect_outlier_count"),
    )
    kinds = labels(
        (F.col("unreadable"), "unreadable"), (readable & F.col("small"), "small"), (readable & F.col("aspect_outlier"), "aspect_outlier")
    )
    rows = flagged.select(*by, "path", F.explode(kinds).alias("kind"))
    first = scale.first_rows(rows, [*by, "kind"], [F.col("path")], limit)
    samples = first.groupBy(*by).agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("path")))).alias(f"{k}_sample")
            for k in ("unreadable", "small", "aspect_outlier")
        ]
    )
    return attach(counts, samples, by)


def cohort_evidence(cohorts: DataFrame, real_counts: DataFrame, measured: DataFrame, base_slug: str) -> DataFrame:
    """What each cohort rests on: the base's own items, real items, or only a hypothesis."""
    joined = cohorts.join(real_counts, "slug", "left").join(
        measured.select("slug", F.lit(True).alias("has_generated_score"), "enhancement_score", "quadrant"), "slug", "left"
    )
    real = F.coalesce("real_item_count", F.lit(0))
    return joined.select(
        "slug",
        pick(
            (F.col("slug") == base_slug, "real_centroid_baseline"), (real > 0, "real_and_generated"),
            otherwise="hypothesis_and_generated",
        ).alias("evidence_type"),
        real.alias("real_item_count"),
        F.coalesce("has_generated_score", F.lit(False)).alias("has_generated_score"),
        "enhancement_score",
        F.coalesce("quadrant", F.lit("unmeasured")).alias("quadrant"),
    )


def evidence_totals(evidence: DataFrame, by: list[str] | None = None) -> DataFrame:
    measured = F.when(F.col("quadrant") != "unmeasured", F.col("quadrant"))
    kinds = ["real_centroid_baseline", "real_and_generated", "hypothesis_and_generated"]
    return evidence.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("cohort_count"),
        *[F.count_if(F.col("evidence_type") == k).alias(k) for k in kinds],
        F.count_if(~F.col("has_generated_score")).alias("unscored_count"),
        F.count_distinct(measured).alias("unique_quadrants"),
    )


# Issue code, severity, backlog item (named in this library's own words).
ISSUES = [
    ("subject_count_low", "warning", "expand-real-subject-set"),
    ("subject_image_imbalance", "warning", "subject-balanced-centroid"),
    ("duplicate_images_present", "warning", "deduplicate-before-centroid"),
    ("small_images_present", "info", "image-resolution-quality-gate"),
    ("aspect_outliers_present", "info", "aspect-and-crop-quality-gate"),
    ("subject_review_failures", "warning", "failed-image-quarantine"),
    ("real_data_missing", "blocking", "real-cohort-data-collection"),
    ("quadrant_separability_low", "warning", "adaptive-8-axis-projection"),
    ("generated_scores_missing", "warning", "score-coverage-gate"),
]
SEVERITY_LEVELS = {"blocking": "needs_real_data_before_strong_claims", "warning": "usable_with_caveats"}


def _issue_rules() -> dict[str, tuple[Column, Column]]:
    """Code -> (condition, evidence number) over the audit metric columns."""
    m = {c: F.coalesce(F.col(c), F.lit(0)) for c in (
        "subject_count", "imbalance_ratio", "duplicate_group_count", "small_count", "aspect_outlier_count", "failed_count",
        "hypothesis_count", "unique_quadrants", "cohort_count", "unscored_count")}
    return {
        "subject_count_low": (m["subject_count"] < 50, m["subject_count"]),
        "subject_image_imbalance": (m["imbalance_ratio"] > 2.0, m["imbalance_ratio"]),
        "duplicate_images_present": (m["duplicate_group_count"] > 0, m["duplicate_group_count"]),
        "small_images_present": (m["small_count"] > 0, m["small_count"]),
        "aspect_outliers_present": (m["aspect_outlier_count"] > 0, m["aspect_outlier_count"]),
        "subject_review_failures": (m["failed_count"] > 0, m["failed_count"]),
        "real_data_missing": (m["hypothesis_count"] > 0, m["hypothesis_count"]),
        "quadrant_separability_low": ((m["unique_quadrants"] < 2) & (m["cohort_count"] > 1), m["unique_quadrants"]),
        "generated_scores_missing": (m["unscored_count"] > 0, m["unscored_count"]),
    }


def collect_issues(metrics: DataFrame, by: list[str]) -> DataFrame:
    """One row per issue of each audit row: severity, code, the number behind it, and its backlog item."""
    rules = _issue_rules()
    found = F.array(
        *[
            F.when(
                rules[code][0],
                F.struct(
                    F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(item).alias("item"),
                    rules[code][1].cast("double").alias("evidence"),
                ),
            )
            for code, severity, item in ISSUES
        ]
    )
    return metrics.select(*by, F.explode(found).alias("i")).where(F.col("i").isNotNull()).select(*by, "i.*")


def backlog(issues: DataFrame, by: list[str]) -> DataFrame:
    return issues.select(*by, "item", F.col("code").alias("source_issue"), "severity")


def risk_levels(audited: DataFrame, issues: DataFrame, by: list[str]) -> DataFrame:
    """Counts by severity and the overall risk of every audited group, clean ones included."""
    counts = issues.groupBy(*by).agg(
        F.count(F.lit(1)).alias("issue_count"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("blocking", "warning", "info")],
    )
    names = [c for c in counts.columns if c not in by]
    full = audited.select(*by).distinct().join(counts, by, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    return full.withColumn(
        "risk_level",
        pick(*[(F.col(f"{s}_count") > 0, text) for s, text in SEVERITY_LEVELS.items()], otherwise="clean"),
    )
