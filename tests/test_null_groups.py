"""Groups with a null key, tables that are one group, and pages nested deeper than a reader goes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import axes, centroids, scoring
from cohortlens.sources import pages


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(1)
    rows = [(f"i{k}", f"s{k % 3}", f"/p{k}", [None, "a", "b"][k % 3], rng.normal(size=4).tolist()) for k in range(9)]
    return spark.createDataFrame(rows, "item_id string, subject string, path string, run string, embedding array<double>")


@pytest.mark.parametrize("limit", [None, 0])
def test_items_of_a_null_group_are_scored(spark, items, limit, monkeypatch):
    if limit is not None:  # models too large for a kernel meet their items in a join
        monkeypatch.setattr(scoring.held_models, "__defaults__", (limit,))
    models = centroids.centroid_models(items, ["run"])
    assert {r["run"] for r in models.select("run").collect()} == {None, "a", "b"}
    got = scoring.score_items(items, models, ["run"]).collect()
    assert len(got) == 9 and all(r["centroid_score"] is not None for r in got)
    left = scoring.score_items(items, models.where("run = 'a'"), ["run"]).collect()
    assert len(left) == 9 and sum(r["centroid_score"] is None for r in left) == 6


def test_cohorts_with_a_null_name(spark, items):
    members = items.select(F.col("run").alias("cohort"), "subject", F.col("embedding").alias("mean_embedding"))
    rows = {r["cohort"]: r for r in centroids.cohort_centroids(members, ["cohort"]).collect()}
    assert set(rows) == {None, "a", "b"} and len(rows[None]["mean_centroid"]) == 4


def test_failed_sample_of_a_null_group(spark):
    df = spark.createDataFrame([(None, "/b", "unreadable"), (None, "/a", "unreadable"), ("x", "/c", "small"), ("x", "/d", None)], "run string, path string, reason string")
    rows = {r["run"]: (r["failed_count"], r["failed_paths"]) for r in scoring.failed_sample(df, ["run"]).collect()}
    assert rows == {None: (2, ["/a", "/b"]), "x": (1, ["/c"])}


def axis_rows(spark, n, groups):
    rng = np.random.default_rng(7)
    matrix = rng.normal(size=(n, len(axes.AXES)))
    rows = [(k, groups[k % len(groups)], *map(float, row)) for k, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "item_id long, run int, " + ", ".join(f"{a} double" for a in axes.AXES)), matrix


def expected(matrix):
    centred = matrix - matrix.mean(axis=0)
    loadings = np.linalg.svd(centred, full_matrices=False)[2][:2]
    loadings = loadings * np.sign(loadings[np.arange(2), np.abs(loadings).argmax(axis=1)])[:, None]
    flat = centred @ loadings.T
    return flat / np.abs(flat).max(axis=0)


def test_projection_of_all_rows_as_one_group(spark):
    df, matrix = axis_rows(spark, 20, [1])
    got = {r["item_id"]: (r["adaptive_x"], r["adaptive_y"]) for r in axes.adaptive_projection(df, []).collect()}
    want = expected(matrix)
    assert len(got) == 20 and all(got[k] == pytest.approx(tuple(want[k]), abs=1e-6) for k in range(20))
    assert axes.adaptive_projection(df.where("false"), []).count() == 0


def test_projection_of_a_null_group(spark):
    df, matrix = axis_rows(spark, 21, [None, 1, 2])
    got = {r["item_id"]: (r["adaptive_x"], r["adaptive_y"]) for r in axes.adaptive_projection(df, ["run"]).collect()}
    assert len(got) == 21
    for group in range(3):
        want = expected(matrix[group::3])
        assert all(got[k] == pytest.approx(tuple(want[i]), abs=1e-6) for i, k in enumerate(range(group, 21, 3)))


def test_deeply_nested_page_state_is_an_error_of_its_own_row(spark):
    state = lambda text: f'<html><script id="SIGI_STATE" type="application/json">{text}</script></html>'
    good = '{"UserModule": {"x": [1, {"userInfo": {"user": {"nickname": "n"}, "stats": {"followerCount": 5}}}]}}'
    deep = "[" * 600 + '{"userInfo": {"user": {}, "stats": {"followerCount": 7}}}' + "]" * 600
    rows = [(1, state("[" * 100_000 + "]" * 100_000)), (2, state(good)), (3, state('{"a": ' * 100_000 + "1" + "}" * 100_000)), (4, state(deep)), (5, None)]
    got = {r["page_id"]: r for r in pages.page_state_stats(spark.createDataFrame(rows, "page_id long, html string"), ["page_id"]).collect()}
    assert {k: r["fetch_status"] for k, r in got.items()} == {1: "error", 2: "ok", 3: "error", 4: "ok", 5: "blocked"}
    assert (got[2]["followers"], got[2]["display_name"], got[4]["followers"]) == (5, "n", 7)
