"""Roster drift: fingerprints of snapshot rows, refresh tasks for changed, new and stale ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["name", "public_examples", "retrieved_at", "slug", "source_urls"]  # in JSON key order

# Reason -> action text.
ACTIONS = {
    "baseline_missing": "Create a baseline drift snapshot before reuse.",
    "source_fingerprint_changed": "Refresh and re-review official roster evidence.",
}


def fingerprint() -> Column:
    """sha256 of the row as compact, key-sorted JSON; null fields stay in it."""
    return F.sha2(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}), 256)


def snapshot(roster: DataFrame) -> DataFrame:
    return roster.withColumn("source_fingerprint", fingerprint())


def parsed_date(text: Column) -> Column:
    """Date of an ISO date or timestamp text, null if it does not parse."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def change_tasks(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows new since, or different from, the previous snapshot; rows that disappeared give no task."""
    before = previous.select("slug", F.col("source_fingerprint").alias("__before"), F.lit(True).alias("__known"))
    joined = current.join(before, "slug", "left")
    reason = F.when(F.col("__known").isNull(), "baseline_missing").when(
        ~F.col("source_fingerprint").eqNullSafe(F.col("__before")), "source_fingerprint_changed"
    )
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    tasks = joined.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return tasks.select(
        "slug", "name", "reason", F.element_at(action, F.col("reason")).alias("action"), "retrieved_at",
        F.lit(None).cast("int").alias("age_days"), "source_fingerprint",
    )


def stale_tasks(current: DataFrame, as_of: Column, max_age_days: int = 90) -> DataFrame:
    """Rows strictly older than the limit."""
    aged = current.withColumn("age_days", F.datediff(as_of, parsed_date(F.col("retrieved_at"))))
    text = F.concat(F.lit("Refresh source metadata; retrieved_at is "), F.col("age_days").cast("string"), F.lit(" days old."))
    return aged.where(F.col("age_days") > max_age_days).select(
        "slug", "name", F.lit("retrieval_stale").alias("reason"), text.alias("action"), "retrieved_at", "age_days", "source_fingerprint"
    )


def refresh_tasks(current: DataFrame, previous: DataFrame, as_of: Column, max_age_days: int = 90) -> DataFrame:
    """Change and staleness tasks; one row may give both."""
    return change_tasks(current, previous).unionByName(stale_tasks(current, as_of, max_age_days))


def task_summary(tasks: DataFrame, by: list[str] | None = None) -> DataFrame:
    reasons = {"changed_count": "source_fingerprint_changed", "stale_count": "retrieval_stale", "baseline_count": "baseline_missing"}
    return tasks.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("task_count"), *[F.count_if(F.col("reason") == r).alias(n) for n, r in reasons.items()]
    )
