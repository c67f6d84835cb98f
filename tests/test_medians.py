"""Element-wise medians against numpy, with samples far smaller than the groups."""

from pathlib import Path

import numpy as np
import pytest
from parity import compare
from pyspark.sql import functions as F

from cohortlens import plans
from cohortlens.functions import medians

QUERIES, ORACLES = plans.load()


def table(spark, groups):
    rows = [(g, k, None if v is None else [float(x) for x in v]) for g, values in groups.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "g string, h int, v array<double>").repartition(5)


def got(df, by):
    return {tuple(r[c] for c in by): r["m"] for r in df.collect()}


def check(spark, groups, **options):
    found = got(medians.element_medians(table(spark, groups).drop("h"), ["g"], "v", "m", **options), ["g"])
    assert set(found) == {(g,) for g, values in groups.items() if any(v is not None for v in values)}
    for (g,), m in found.items():
        assert m == pytest.approx(np.median(np.array([v for v in groups[g] if v is not None], float), axis=0).tolist(), abs=1e-15)


def made():
    rng = np.random.default_rng(4)
    return {
        "small": rng.normal(size=(7, 3)).tolist(), "even": rng.normal(size=(4000, 3)).tolist(), None: rng.normal(size=(3001, 3)).tolist(),
        "ties": rng.integers(0, 3, size=(2500, 3)).tolist(), "same": [[1.0, -2.0, 0.5]] * 2000, "one": [[5, 6, 7]],
        "two values": [[0.0, 1.0, 2.0]] * 900 + [[1.0, 5.0, 2.0]] * 900, "nulls": [None, [1.0, 2.0, 3.0], None], "only null": [None],
        "wide": (rng.normal(size=(2000, 3)) * [1e-9, 1.0, 1e12]).tolist(), "skewed": np.exp(5 * rng.normal(size=(3000, 3))).tolist(),
    }


def test_groups_larger_than_a_sample(spark):
    check(spark, made(), sample_bytes=1)  # 64 rows


def test_groups_within_a_sample(spark):
    check(spark, made())


def test_a_bracket_that_misses_costs_no_result(spark, monkeypatch):
    real = medians._sampled

    def off(rows, by, n):  # brackets far from the medians
        return real(rows, by, n).selectExpr("g", "n", "whole", "CASE WHEN whole THEN low ELSE transform(low, x -> x + 1e6D) END AS low", "CASE WHEN whole THEN high ELSE transform(high, x -> x + 2e6D) END AS high")

    monkeypatch.setattr(medians, "_sampled", off)
    check(spark, {"a": np.random.default_rng(1).normal(size=(500, 2)).tolist(), "b": [[1.0, 2.0]]}, sample_bytes=1)


def test_one_group_of_all_rows(spark):
    values = np.random.default_rng(2).normal(size=(1000, 4))
    df = table(spark, {"a": values.tolist()})
    for options in ({}, {"sample_bytes": 1}):
        assert got(medians.element_medians(df, [], "v", "m", **options), [])[()] == pytest.approx(np.median(values, axis=0).tolist(), abs=1e-15)
        assert medians.element_medians(df.where("false"), [], "v", "m", **options).count() == 0
    assert medians.element_medians(df.where("false"), ["g"], "v", "m").count() == 0


def test_counts_added_up_from_many_tasks(spark):
    """The summarizer's sums end just beside whole numbers; cut off instead of rounded they move the middle ranks."""
    cells = [(F.xxhash64("id", F.lit(i)) / 1e18).alias(str(i)) for i in range(16)]
    df = spark.range(0, 20_001, 1, 41).select(F.array(*cells).alias("v"))
    want = np.median([r["v"] for r in df.collect()], axis=0).tolist()
    assert got(medians.element_medians(df, [], "v", "m"), [])[()] == want


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """(folder, connection): the tables of sf0.01, five vectors for every one, in 41 files that stay 41 tasks."""
    import duckdb

    from cohortlens.plans.registry import TABLES

    source, folder = Path("/root/testdata/sf0.01"), tmp_path_factory.mktemp("split")
    rows = spark.read.parquet(f"{source}/embeddings.parquet")
    made = F.transform("embedding", lambda e, i: (e * (1 + 0.3 * F.sin(F.col("k") * (i + 1)))).cast("float")).alias("embedding")
    shifted = rows.crossJoin(spark.range(5).withColumnRenamed("id", "k"))
    size = rows.count()
    shifted.select((F.col("vec_id") + F.col("k") * size).alias("vec_id"), made, "label").repartition(41).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    for table in TABLES:
        if table != "embeddings":
            (folder / f"{table}.parquet").symlink_to(source / f"{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet{'/*.parquet' if table == 'embeddings' else ''}'")
    return str(folder), con


@pytest.mark.parametrize("name", ["j6_calibration_summary", "j6_regenerate_first", "j6_seed_plan", "j7_cohort_pages", "k6_candidate_order", "m8_score_ranking"])
def test_queries_whose_centroid_is_larger_than_a_sample(spark, split, monkeypatch, name):
    monkeypatch.setattr(medians, "SAMPLE_ROWS", 64)
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    try:
        problem, count = compare(spark, split[1], name, QUERIES[name], ORACLES[name], split[0])
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert problem is None and count > 0, problem


def test_plan_has_no_row_per_element(spark):
    df = table(spark, {"a": np.ones((500, 3)).tolist(), "b": [[1.0, 2.0, 3.0]]})
    plan = medians.element_medians(df, ["g"], "v", "m", sample_bytes=1)._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_exported_grids_come_back_with_their_positions(spark):
    from cohortlens.operators import centroids

    values = [float(x) for x in range(24)]
    models = spark.createDataFrame([("a", values, [1.0, 2.0])], "g string, appearance array<double>, embedding array<double>")
    rows = centroids.export_rows(models, ["g"], ["appearance", "embedding"], {"appearance": [2, 4, 3]})
    back = centroids.read_back_export(rows, ["g"])
    assert {r["vector"]: r["dims"] for r in back.collect()} == {"appearance": [2, 4, 3], "embedding": [2]}
    placed = rows.join(back.select("vector", "dims"), "vector").withColumn("at", centroids.grid_position("index", "dims"))
    cube = np.array(values).reshape(2, 4, 3)
    found = [r for r in placed.collect() if r["vector"] == "appearance"]
    assert len(found) == 24 and all(cube[tuple(r["at"])] == r["value"] for r in found)
    with pytest.raises(Exception, match="length of its shape"):
        centroids.export_rows(models, ["g"], ["embedding"], {"embedding": [3]}).collect()
