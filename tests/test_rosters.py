"""Rosters: subjects that only the items name."""

import shutil

import duckdb
from parity import compare, duck
from pyspark.sql import functions as F

from cohortlens import plans
from cohortlens.plans.registry import TABLES


def test_manifest_has_a_row_for_every_subject_of_the_items(spark, folder, tmp_path):
    """Subjects beyond the nation keys, and items without one."""
    for table in TABLES:
        if table != "embeddings":
            shutil.copy(f"{folder}/{table}.parquet", tmp_path)
    label = "CASE WHEN vec_id % 41 = 40 THEN NULL ELSE vec_id % 41 END"
    duckdb.sql(f"COPY (SELECT * REPLACE ({label} AS label) FROM '{folder}/embeddings.parquet') TO '{tmp_path}/embeddings.parquet'")
    queries, oracles = plans.load()
    name = "d7_subject_manifest_rows"
    rows = queries[name](spark, str(tmp_path))
    assert {r["subject"] for r in rows.collect()} == {None, *(f"s{k}" for k in range(40))}
    total = rows.agg(F.sum(F.col("item_count") + F.col("failed_count"))).first()[0]
    assert total == spark.read.parquet(f"{tmp_path}/embeddings.parquet").count()
    problem, count = compare(spark, duck(str(tmp_path)), name, queries[name], oracles[name], str(tmp_path))
    assert problem is None and count == 41, problem
