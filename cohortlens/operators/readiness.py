"""Evidence readiness of models: required and optional checks, what is missing, what to do next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import r6

# Checks in order: check, required, next action (the texts are this library's own).
CHECKS = [
    ("model_profile", True, "Build a centroid model with its profile"),
    ("centroid_vectors", True, "Build mean and median centroid vectors"),
    ("model_audit", False, "Run the model audit for mean/median vector distance evidence"),
    ("vector_export", False, "Export vectors for portable mean/median vector evidence"),
    ("generation_review", True, "Review generated candidates"),
    ("evaluation", True, "Score generated candidates"),
    ("quality_review", True, "Run the quality gate on the candidates"),
    ("subject_review", True, "Review subjects for near-centroid ranking"),
    ("backend_comparison", True, "Compare encoders for rank-agreement evidence"),
    ("subject_backend_comparison", True, "Compare encoders on subject rankings"),
    ("correlation_report", False, "Correlate scores with channel engagement"),
    ("face_ingredients", False, "Summarise descriptors"),
    ("benchmark_research", False, "Add benchmark guidance"),
]


def readiness(models: DataFrame, evidence: DataFrame, key: str = "model") -> DataFrame:
    """Ready counts and ratio of the required checks, missing lists, and the first required action still open.

    ``evidence`` has (key, check, ready) rows; several rows of one check count as ready if any is.  A check without
    evidence is not ready.  Lists are at most as long as the fixed check list.
    """
    seen = evidence.groupBy(key, "check").agg(F.bool_or("ready").alias("ready"))
    declared = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(n).alias("check"), F.lit(req).alias("required"), F.lit(todo).alias("next_action"))
            for i, (n, req, todo) in enumerate(CHECKS)
        ]
    )
    rows = models.select(key).distinct().select(key, F.explode(declared).alias("c")).select(key, "c.*")
    checked = rows.join(seen, [key, "check"], "left").withColumn("ready", F.coalesce("ready", F.lit(False)))
    required, ready = F.col("required"), F.col("ready")

    def missing(kind):
        listed = F.array_sort(F.collect_list(F.when(kind & ~ready, F.struct("position", "check"))))
        return F.transform(listed, lambda e: e["check"])

    return checked.groupBy(key).agg(
        F.count_if(required & ready).alias("ready_count"),
        F.count_if(required).alias("total_count"),
        r6(F.count_if(required & ready) / F.count_if(required)).alias("ready_ratio"),
        F.count_if(~required & ready).alias("optional_ready_count"),
        F.count_if(~required).alias("optional_total_count"),
        missing(required).alias("missing"),
        missing(~required).alias("optional_missing"),
        F.min_by("next_action", F.when(required & ~ready, F.col("position"))).alias("next_action"),
    )
