"""Skewed groups: a third and more of all rows in one key, heavy ties, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import scale


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 30000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n))
    value = np.where(rng.random(n) < 0.4, 1.5, np.round(rng.standard_cauchy(n), 3))
    pdf = pd.DataFrame({"key": key, "value": value, "id": np.arange(n)})
    pdf.loc[::97, "value"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("value", F.when(~F.isnan("value"), F.col("value"))).repartition(16)
    return pdf, df


def test_exact_percentiles(skewed):
    pdf, df = skewed
    probs = {"p2": 0.025, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    got = {r["key"]: r for r in scale.exact_percentiles(df, ["key"], "value", probs, accuracy=500).collect()}
    for key, part in pdf.groupby("key"):
        values = part["value"].dropna()
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.percentile(values, p * 100), abs=1e-12), (key, name)


def test_exact_percentiles_beyond_the_window_limit(skewed, monkeypatch):
    """The same answers when no group may be held by one window."""
    pdf, df = skewed
    monkeypatch.setattr(scale, "WINDOW_LIMIT_ROWS", 0)
    for by in (["key"], []):
        got = scale.exact_percentiles(df, by, "value", {"a": 0.3, "b": 0.5}, accuracy=100)
        assert "__local" in got._jdf.queryExecution().optimizedPlan().toString()
        for row in got.collect():
            values = pdf["value"].dropna() if not by else pdf.loc[pdf["key"] == row["key"], "value"].dropna()
            assert row["a"] == pytest.approx(np.percentile(values, 30)) and row["b"] == np.median(values)


def test_running_totals(skewed):
    pdf, df = skewed
    got = scale.running_totals(df.select("key", "id", F.lit(2).alias("two")), ["key"], [F.col("id")], "two", "total").toPandas()
    want = pdf.sort_values("id").groupby("key").cumcount() + 1
    merged = got.merge(want.rename("n").reset_index().rename(columns={"index": "id"}), on="id")
    assert (merged["total"] == 2 * merged["n"]).all()


def test_exact_percentiles_without_groups(skewed):
    pdf, df = skewed
    row = scale.exact_percentiles(df, [], "value", {"m": 0.5, "q": 0.75}, accuracy=300).first()
    assert row["m"] == np.median(pdf["value"].dropna()) and row["q"] == pytest.approx(np.percentile(pdf["value"].dropna(), 75))


def test_percentiles_of_tiny_and_constant_groups(spark):
    df = spark.createDataFrame([("one", 3.0), ("two", 1.0), ("two", 2.0), ("same", 5.0), ("same", 5.0), ("same", 5.0)], "key string, value double")
    got = {r["key"]: r["m"] for r in scale.exact_median(df, ["key"], "value", "m").collect()}
    assert got == {"one": 3.0, "two": 1.5, "same": 5.0}


def test_row_numbers_with_ties(skewed):
    pdf, df = skewed
    rows = df.where("value is not null")
    got = scale.row_numbers(rows, ["key"], [F.col("value").desc(), F.col("id").asc()], "rank").toPandas()
    want = pdf.dropna().sort_values(["key", "value", "id"], ascending=[True, False, True]).copy()
    want["rank"] = want.groupby("key").cumcount() + 1
    merged = got.merge(want[["id", "rank"]], on="id", suffixes=("", "_want"))
    assert len(merged) == len(want) and (merged["rank"] == merged["rank_want"]).all()


def test_row_numbers_without_groups(skewed):
    _, df = skewed
    ranks = scale.row_numbers(df.select("id"), [], [F.col("id")], "rank").toPandas()
    assert (ranks["rank"] == ranks["id"] + 1).all()


def test_average_ranks(skewed):
    pdf, df = skewed
    got = scale.average_ranks(df.where("value is not null"), ["key"], "value", "rank").toPandas()
    want = pdf.dropna().copy()
    want["rank"] = want.groupby("key")["value"].rank(method="average")
    merged = got.merge(want[["id", "rank"]], on="id", suffixes=("", "_want"))
    assert np.allclose(merged["rank"], merged["rank_want"])


def test_small_side_measures_before_broadcasting(skewed):
    _, df = skewed
    keys = df.select("key").distinct()
    assert "BroadcastHashJoin" in df.join(scale.small_side(keys), "key")._jdf.queryExecution().executedPlan().toString()
    far = df.join(scale.small_side(df.select("key", F.col("id").alias("other")), limit_bytes=10).hint("merge"), "key")
    assert "Broadcast" not in far._jdf.queryExecution().executedPlan().toString()


def test_rank_plan_has_no_window_over_a_group(skewed):
    """Only the one-row-per-partition counts meet a window."""
    _, df = skewed
    plan = scale.row_numbers(df, ["key"], [F.col("id")], "rank")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "row_number" not in plan


def test_beside_keeps_rows(spark):
    left, one = spark.range(5), spark.range(3).agg(F.max("id").alias("top"))
    assert [r["top"] for r in scale.beside(left, one).collect()] == [2] * 5
