"""Headline queries at one scale: prints one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, or "all").
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "a7_score_sheet_round_trip", "b1_site_links", "b7_candidate_manifest", "c4_edge_features", "c6_vectorised_items", "d2_mean_vector",
    "d3_median_vector", "d4_item_weighted_centroid", "d5_subject_balanced_centroid", "d13_stability_by_run", "e3_score_table",
    "e4_score_rank", "e5_score_summary", "e6_null_calibration", "e9_subject_reviews", "f8_condition_strata", "f9_adaptive_projection",
    "g2_quality_gate", "g5_duplicate_groups", "i4_fused_score", "k1_run_review", "l1_rank_agreement", "m5_spearman",
    "n4_merge_overwrite", "o3_refresh_tasks", "q2_candidate_checks", "r1_readiness",
]


def main() -> None:
    from cohortlens import plans

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = plans.load()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cohortlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("d2_mean_vector", "e3_score_table", "b1_site_links"):  # JVM and Python workers warm
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
