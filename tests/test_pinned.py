"""Cases with known answers: centroids, scores, gates, engagement, correlation, drift, rubric."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import vectors as vec
from cohortlens.operators import agreement, axes, calibration, centroids, cohorts, correlation, drift, engagement, fusion, gates, resampling, rubric, runs
from cohortlens.operators import scoring


def items_of(spark, rows):
    return spark.createDataFrame(
        [(i, s, f"/{s}/{i}.png", v) for i, s, v in rows], "item_id string, subject string, path string, embedding array<double>"
    )


def test_member_centroid_of_a_non_unit_vector(spark):
    members = spark.createDataFrame([("c", "a", [1.0, 0.0, 0.0, 0.0]), ("c", "b", [0.0, 3.0, 0.0, 0.0])], "cohort string, subject string, mean_embedding array<double>")
    row = centroids.cohort_centroids(members, ["cohort"]).first()
    want = np.array([0.5, 1.5, 0, 0]) / np.linalg.norm([0.5, 1.5])
    assert np.allclose(row["mean_centroid"], want) and row["subject_count"] == 2


def test_score_divides_by_the_item_norm_and_guards_zero(spark):
    items = items_of(spark, [("x", "s", [0.0, 3.0, 0.0, 0.0]), ("zero", "s", [0.0, 0.0, 0.0, 0.0])])
    model = spark.createDataFrame([([0.0, 1.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0])], "mean_embedding array<double>, median_embedding array<double>")
    got = {r["item_id"]: r for r in scoring.score_items(items, model).collect()}
    assert got["x"]["cosine_to_mean"] == pytest.approx(1.0) and got["x"]["euclidean_to_mean"] == pytest.approx(2.0)
    assert got["x"]["centroid_score"] == pytest.approx(0.5)
    assert got["zero"]["cosine_to_mean"] == 0.0 and got["zero"]["euclidean_to_median"] == pytest.approx(1.0)


def test_grouped_and_single_model_scores_agree(spark):
    rng = np.random.default_rng(1)
    items = items_of(spark, [(str(i), "s", rng.normal(size=5).tolist()) for i in range(40)])
    one = scoring.score_items(items, centroids.centroid_models(items))
    many = scoring.score_items(items, centroids.centroid_models(items, ["subject"]), ["subject"])
    a, b = ({r["item_id"]: r for r in d.collect()} for d in (one, many))
    for key in a:
        for c in scoring.SCORE_COLUMNS:
            assert a[key][c] == pytest.approx(b[key][c], abs=1e-12)


def test_subject_balance_counts_each_subject_once(spark):
    items = items_of(spark, [("1", "a", [1.0, 0.0]), ("2", "a", [1.0, 0.0]), ("3", "a", [1.0, 0.0]), ("4", "b", [0.0, 1.0])])
    row = centroids.centroid_models(items, mode="subject_balanced").first()
    assert np.allclose(row["mean_embedding"], [math.sqrt(0.5)] * 2)
    assert (row["subject_count"], row["item_count"], row["centroid_mode"]) == (2, 4, "subject_balanced")
    with pytest.raises(ValueError):
        centroids.centroid_models(items, mode="other")


def test_subject_vector_states(spark):
    roster = spark.createDataFrame([("a",), ("b",), ("c",)], "subject string")
    items = items_of(spark, [("1", "a", [2.0, 0.0]), ("2", "a", None), ("3", "b", None)])
    got = {r["subject"]: r for r in centroids.subject_vectors(roster, items).collect()}
    assert [(got[s]["status"], got[s]["item_count"], got[s]["failed_count"]) for s in "abc"] == [("ok", 1, 1), ("failed", 0, 1), ("empty", 0, 0)]
    assert got["a"]["mean_embedding"] == [1.0, 0.0] and got["b"]["mean_embedding"] is None


def test_pair_of_orthogonal_centroids(spark):
    df = spark.createDataFrame([("k", [1.0, 0.0], [0.0, 1.0]), ("short", [1.0, 0.0], [1.0]), ("none", None, [1.0])], "k string, l array<double>, r array<double>")
    got = {r["k"]: r for r in centroids.pair_summary(df, ["k"], "l", "r").collect()}
    assert (got["k"]["cosine"], got["k"]["euclidean"]) == (0.0, 1.414214)
    assert not got["short"]["available"] and got["short"]["error"] == "shape mismatch" and not got["none"]["available"]


def test_stability_cases(spark):
    same = items_of(spark, [(str(i), "s", [0.1, 0.2, 0.3]) for i in range(5)])
    row = resampling.centroid_stability(same, ["subject"], resamples=20).first()
    assert (row["self_cosine_mean"], row["self_cosine_low"], row["band"], row["unit_count"]) == (1.0, 1.0, "stable", 5)
    subjects = items_of(spark, [("1", "a", [1.0, 0.0]), ("2", "a", [1.0, 0.1]), ("3", "a", [1.0, 0.0]), ("4", "b", [0.0, 1.0])])
    assert resampling.centroid_stability(subjects, [], subject="subject", resamples=10).first()["unit_count"] == 2
    single = resampling.centroid_stability(items_of(spark, [("1", "a", [1.0, 0.0])]), [], resamples=10).first()
    assert (single["band"], single["self_cosine_mean"], single["resamples"]) == ("insufficient_units", 1.0, 0)


def random_word(seed, resample, node, count):
    """The draws' 64 random bits in whole numbers of any size."""
    x = resample * 0x9FB21C651E98DF25 + node * 0xD6E8FEB86659FD93 + count * 0x9E3779B97F4A7C15 + seed * 0xA0761D6478BD642F
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x %= 2**64
        x = (x ^ (x >> shift)) * factor
    x %= 2**64
    return x ^ (x >> 31)


def test_bootstrap_matches_a_direct_computation(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(12, 4)) + 1
    items = items_of(spark, [(f"{i:02d}", "s", v.tolist()) for i, v in enumerate(vectors)])
    got = {r["resample"]: r["cosine"] for r in resampling.resampled_cosines(resampling.unit_templates(items, [], None), [], 7, 5).collect()}
    full = vectors.mean(axis=0)
    for b in range(7):
        picks = [(random_word(5, b, 1, i) >> 11) % 12 for i in range(12)]
        centre = vectors[picks].mean(axis=0)
        assert got[b] == pytest.approx(centre @ full / np.linalg.norm(centre) / np.linalg.norm(full), abs=1e-12)


def test_draws_over_buckets_are_a_multinomial(spark):
    sizes = spark.createDataFrame([("a", 0, 30), ("a", 1, 10), ("a", 5, 60), (None, 2, 7), (None, 3, 0 + 1)], "g string, __bucket long, n long")
    rows = {(r["g"], r["__bucket"]): np.array(r["draws"]) for r in resampling.bucket_draws(sizes, ["g"], 3, 2000, 1).collect()}
    assert set(rows) == {("a", 0), ("a", 1), ("a", 5), (None, 2), (None, 3)}
    assert (rows["a", 0] + rows["a", 1] + rows["a", 5] == 100).all() and (rows[None, 2] + rows[None, 3] == 8).all()
    for bucket, share in ((0, 0.3), (1, 0.1), (5, 0.6)):
        draws = rows["a", bucket]
        assert abs(draws.mean() - 100 * share) < 0.6 and abs(draws.var() - 100 * share * (1 - share)) < 2.5
    assert abs(np.cov(rows["a", 0], rows["a", 5])[0, 1] + 100 * 0.3 * 0.6) < 2.5


def test_binomial_inverts_the_distribution():
    for n, share in ((1, 0.5), (9, 0.02), (60, 0.7), (500, 0.31)):
        chances = [math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(n + 1)]
        uniform = np.linspace(0.0005, 0.9995, 333)
        want = [int((np.cumsum(chances) < u).sum()) for u in uniform]
        assert resampling.binomial(np.full(333, n), share, uniform).tolist() == want
    large = resampling.binomial(np.full(2, 10**9), 0.25, np.array([0.5, 0.975]))
    assert abs(large[0] - 2.5e8) < 3 and abs(large[1] - 2.5e8 - 1.95996 * math.sqrt(10**9 * 0.1875)) < 30
    assert resampling.binomial(np.array([0, 5]), 1.0, np.array([0.1, 0.2])).tolist() == [0, 5]


def test_quality_gate_reasons(spark):
    df = spark.createDataFrame([(1, 0.2, 0.1), (4, 0.2, 0.1), (1, 0.7, 0.1), (1, 0.2, 0.4), (1, 0.01, 0.0), (0, None, None)], "n int, ratio double, off double")
    got = [r[0] for r in df.select(gates.gate_reason(F.col("n"), F.col("ratio"), F.col("off"))).collect()]
    assert got == ["single centered face", "requires exactly one detected face", "detected face is too close or cropped",
                   "detected face is off center", "detected face is too small", "requires exactly one detected face"]


def test_gate_summary_without_rows_has_no_rate(spark):
    row = gates.gate_summary(spark.createDataFrame([], "qa_pass boolean"), []).first()
    assert row["item_count"] == 0 and row["pass_rate"] is None


def test_axis_defaults_only_for_missing_keys(spark):
    df = spark.createDataFrame([("missing", {}), ("wrong", {"luminance": None, "symmetry": None})], "k string, m map<string,double>")
    got = {r["k"]: r for r in axes.add_axes(axes.descriptor_columns(df, "m")).collect()}
    assert got["missing"]["dynamic_symmetric"] == pytest.approx((0.10 / 0.24) * 2 - 1, abs=1e-6)
    assert got["wrong"]["dynamic_symmetric"] == -1.0


def test_projection_matches_svd(spark):
    rng = np.random.default_rng(5)
    data = np.round(rng.uniform(-1, 1, size=(60, 8)), 6)
    df = spark.createDataFrame([(i, "g", *map(float, r)) for i, r in enumerate(data)], "item_id int, run string, " + ", ".join(f"{a} double" for a in axes.AXES))
    got = {r["item_id"]: (r["adaptive_x"], r["adaptive_y"]) for r in axes.adaptive_projection(df, ["run"]).collect()}
    centred = data - data.mean(axis=0)
    _, s, vh = np.linalg.svd(centred, full_matrices=False)
    vh = vh[:2] * np.sign(vh[np.arange(2), np.abs(vh[:2]).argmax(axis=1)])[:, None]
    xy = centred @ vh.T
    xy = xy / np.abs(xy).max(axis=0)
    assert all(np.allclose(got[i], xy[i], atol=2e-6) for i in got)
    explained = axes.principal_axes(df, ["run"]).first()["explained"]
    assert np.allclose(explained, (s**2 / (s**2).sum())[:2])
    lone = axes.principal_axes(df.limit(1), ["run"]).first()
    assert lone["unavailable_reason"] == "requires_at_least_two_images"


def test_weights_and_unit_scores(spark):
    df = spark.createDataFrame([(-1.0, None, 0.0), (1.0, 1.0, 2.0)], "w_descriptor_similarity double, w_image_centroid_score double, w_axis_alignment double")
    rows = fusion.normalised_weights(df).collect()
    assert list(rows[0]) == [0.0, 0.0, 0.0] and list(rows[1]) == [0.25, 0.25, 0.5]
    scores = spark.createDataFrame([(None,), (-1.0,), (0.5,), (3.0,)], "s double").select(fusion.unit_score(F.col("s"))).collect()
    assert [r[0] for r in scores] == [0.0, 0.0, 0.75, 1.0]


def test_gap_of_a_missing_value_is_the_target(spark):
    df = spark.createDataFrame([(None,), (0.3,), (0.9,)], "v double").select(calibration.gap(0.35, F.col("v")).alias("g"))
    assert [round(r["g"], 6) for r in df.collect()] == [0.35, 0.05, 0.0]


def test_similarity_of_the_base_is_one(spark):
    base = spark.createDataFrame([tuple([0.5] * 9)], ", ".join(f"{k} double" for k in cohorts.DESCRIPTOR_KEYS))
    rows = spark.createDataFrame([("base", {}), ("far", {"luminance": 0.9, "warmth": -3.0})], "slug string, offsets map<string,double>")
    got = {r["slug"]: r for r in cohorts.add_base_distance(cohorts.average_descriptors(rows, base)).collect()}
    assert got["base"]["descriptor_similarity"] == 1.0 and got["far"]["luminance"] == 1.0 and got["far"]["warmth"] == -1.0


def test_sheet_import(spark):
    columns = "subject, channel, handle, followers, following, posts, total_engagement, engagement_rate, display_name, bio".split(", ")
    raw = spark.createDataFrame([("talent_a", "Instagram", "@talent_a", "1,200", "", "20", "240", "", "", ""), ("", "x", "y", "1", "", "", "", "", "", "")], columns)
    rows = engagement.import_rows(raw).collect()
    assert len(rows) == 1
    assert (rows[0]["followers"], rows[0]["engagement_rate"], rows[0]["handle"], rows[0]["profile_url"]) == (1200, 0.01, "talent_a", "https://www.instagram.com/talent_a/")


def test_numbers_that_java_would_accept_are_refused(spark):
    df = spark.createDataFrame([("1d",), ("2.5f",), ("1e3",), ("1.2K",), ("3m",), ("N/A",), ("-5",)], "t string")
    assert [r[0] for r in df.select(engagement.clean_count(F.col("t"))).collect()] == [None, None, 1000, 1200, 3000000, None, -5]


def test_cache_key_is_case_free_and_expiry_is_strict(spark):
    cache = spark.createDataFrame([("instagram", "talent_a", 1200, "2024-01-01 00:00:00", "ok")], "channel string, handle string, followers bigint, fetched_at string, fetch_status string")
    cache = cache.withColumn("fetched_at", F.to_timestamp("fetched_at"))
    wanted = spark.createDataFrame([("instagram", "TALENT_A")], "channel string, handle string")
    at = lambda text: F.to_timestamp(F.lit(text))
    assert engagement.cache_lookup(wanted, cache, at("2024-01-02 00:00:00"), 24).count() == 1
    assert engagement.cache_lookup(wanted, cache, at("2024-01-02 00:00:01"), 24).count() == 0
    assert engagement.split_requests(wanted, cache, at("2024-01-01 10:00:00")).first()["plan"] == "cached"
    assert engagement.split_requests(wanted, cache, at("2024-01-01 10:00:00"), force=True).first()["plan"] == "fetch"


def test_correlation_of_three_subjects_and_p_values(spark):
    rows = [("a", 0.9, 900), ("b", 0.6, 600), ("c", 0.3, 300), ("d", None, 5), ("e", 0.1, None)]
    data = spark.createDataFrame(rows, "subject string, mean_centroid_score double, followers bigint").withColumn("flat", F.lit(1))
    result = {r["variable_b"]: r for r in correlation.correlation_report(correlation.correlations(data, ["mean_centroid_score"], ["followers", "flat"])).collect()}
    assert result["followers"]["n"] == 3 and result["followers"]["pearson_r"] == 1.0 and result["followers"]["interpretation"].startswith("strong_positive")
    assert result["flat"]["pearson_r"] is None and result["flat"]["interpretation"] == "no_data"
    few = correlation.correlations(data.limit(2), ["mean_centroid_score"], ["followers"]).first()
    assert few["n"] == 2 and few["pearson_r"] is None


@pytest.mark.parametrize("r, n", [(0.5, 10), (-0.8, 6), (0.3, 100), (0.0, 20), (0.95, 4), (1.0, 5), (0.05, 1000), (0.2, 7)])
def test_p_value_against_the_density_of_r(spark, r, n):
    """Under no correlation r has the density (1 - r^2)^((n - 4) / 2)."""
    x = (np.arange(2_000_000) + 0.5) / 2_000_000
    density = (1 - x * x) ** ((n - 4) / 2)
    want = density[x > abs(r)].sum() / density.sum()
    got = spark.createDataFrame([(r, n)], "r double, n bigint").select(correlation.p_value("r", "n")).first()[0]
    assert got == pytest.approx(want, abs=2e-6)


def test_nan_correlation_never_wins(spark):
    df = spark.createDataFrame([("a", "b", 5, float("nan")), ("c", "d", 5, 0.5)], "variable_a string, variable_b string, n bigint, spearman_r double")
    row = correlation.top_pair(df).first()
    assert (row["top_variable_a"], row["top_spearman_r"], row["correlation_count"]) == ("c", 0.5, 2)


def test_agreement_joins_on_path_and_ranks_ties_in_path_order(spark):
    rows = [("a", "x/dup.png", 0.9), ("a", "y/dup.png", 0.1), ("b", "x/dup.png", 0.5), ("b", "y/dup.png", 0.5), ("a", "only.png", 0.4)]
    df = spark.createDataFrame(rows, "encoder string, path string, score double")
    got = {(r["encoder_a"], r["encoder_b"]): r for r in agreement.rank_agreement(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")]["common_count"] == 2 and got[("a", "b")]["spearman_rank"] == -1.0
    assert got[("a", "c")]["common_count"] == 0 and got[("a", "c")]["spearman_rank"] is None


def test_negative_scores_are_valid_and_paths_decide(spark):
    scores = spark.createDataFrame([("r", "dup", "a/dup.png", -0.2), ("r", "dup", "b/dup.png", -0.6)], "run string, item_id string, path string, centroid_score double")
    styles = spark.createDataFrame([("r", "dup", "A/./dup.png", -0.4), ("r", "dup", "c/dup.png", 0.9)], "run string, item_id string, path string, style_score double")
    bases = F.array(F.lit("/work/run"))
    row = runs.best_combined(runs.with_keys(scores, bases), runs.with_keys(styles, bases), ["run"]).first()
    assert row["best_combined_score"] == pytest.approx(-0.3) and row["best_combined_path"] == "a/dup.png"


def test_path_keys(spark):
    df = spark.createDataFrame([("/A/../B//c/./X.png",), ("x/../y.png",)], "p string")
    got = [r[0] for r in df.select(runs.path_keys(F.col("p"), F.array(F.lit("/base"), F.lit("/run/one")))).collect()]
    assert got == [["/b/c/x.png"], ["/base/y.png", "/run/one/y.png"]]


def test_rubric_decisions(spark):
    candidates = spark.createDataFrame([("b", "x", 0.52, 1), ("b", "y", 0.46, 2), ("b", "z", 0.44, 3)], "batch string, item_id string, centroid_score double, rank int")
    quality = spark.createDataFrame([("x", True, "ok"), ("y", False, "bad")], "item_id string, qa_pass boolean, reason string")
    flags = spark.createDataFrame([("x", ["no_major_presentation_flags"]), ("y", ["dark_or_underlit_image"]), ("z", ["no_major_presentation_flags"])], "item_id string, presentation_flags array<string>")
    got = {r["item_id"]: r for r in rubric.candidate_reviews(candidates, quality, flags, ["item_id"]).collect()}
    assert [got[k]["recommendation"] for k in "xyz"] == ["promote", "reject", "review"]
    assert got["y"]["failed_checks"] == ["quality", "presentation"]
    pairs = {(r["winner"], r["loser"]): r["decision"] for r in rubric.pairwise_comparisons(candidates, ["batch"]).collect()}
    assert pairs == {("x", "y"): "clear_win", ("x", "z"): "clear_win", ("y", "z"): "too_close"}


def test_rubric_rows_with_missing_parts(spark):
    candidates = spark.createDataFrame([("b", x, 0.5, i) for i, x in enumerate("vwxyz", 1)], "batch string, item_id string, centroid_score double, rank int")
    quality = spark.createDataFrame([("v", True, None), ("w", None, "undecided"), ("x", True, "ok"), ("y", True, "ok")], "item_id string, qa_pass boolean, reason string")
    flags = spark.createDataFrame([("v", None), ("w", []), ("x", None), ("z", [])], "item_id string, presentation_flags array<string>")
    got = {r["item_id"]: r for r in rubric.candidate_reviews(candidates, quality, flags, ["item_id"]).collect()}
    assert {k: r["recommendation"] for k, r in got.items()} == {"v": "promote", "w": "review", "x": "promote", "y": "review", "z": "review"}
    assert {k: r["quality_reason"] for k, r in got.items()} == {"v": None, "w": "undecided", "x": "ok", "y": "ok", "z": "quality report unavailable"}
    assert {k: r["presentation_pass"] for k, r in got.items()} == {"v": True, "w": True, "x": True, "y": None, "z": True}
    batches = spark.createDataFrame([("a", True, None), ("b", False, 0.99), ("c", True, 0.95), ("d", None, None)], "batch string, calibrated boolean, best_percentile double")
    rows = {r["batch"]: (r["null_available"], r["null_pass"]) for r in rubric.batch_null_review(batches, available="calibrated").collect()}
    assert rows == {"a": (True, False), "b": (False, None), "c": (True, True), "d": (False, None)}


def test_drift_reasons(spark):
    base = "slug string, name string, retrieved_at string, source_urls array<string>, public_examples array<string>"
    before = drift.snapshot(spark.createDataFrame([("a", "A", "2026-06-15", ["u"], ["x"]), ("gone", "G", None, [], [])], base))
    now = drift.snapshot(spark.createDataFrame([("a", "A", "2026-06-15T00:00:00Z", ["v"], ["x"]), ("new", "N", "bad", ["u"], [])], base))
    rows = drift.refresh_tasks(now, before, F.to_date(F.lit("2026-10-01")), 30).collect()
    assert sorted((r["slug"], r["reason"]) for r in rows) == [("a", "retrieval_stale"), ("a", "source_fingerprint_changed"), ("new", "baseline_missing")]
    import hashlib
    import json

    want = {"name": "N", "public_examples": [], "retrieved_at": "bad", "slug": "new", "source_urls": ["u"]}
    text = json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert {r["slug"]: r["source_fingerprint"] for r in rows}["new"] == hashlib.sha256(text.encode()).hexdigest()


def test_digests(spark):
    import hashlib

    df = spark.createDataFrame([([0.5, -1.25],)], "v array<double>")
    row = df.select(vec.float32_digest("v").alias("b"), vec.text_digest(F.col("v")).alias("t")).first()
    assert row["b"] == hashlib.sha256(np.array([0.5, -1.25], "<f4").tobytes()).hexdigest()
    assert row["t"] == hashlib.sha256(b"0.500000,-1.250000").hexdigest()


def test_vector_kernels_with_gaps(spark):
    df = spark.createDataFrame([([3.0, 4.0],), (None,), ([],), ([1e-13, 0.0],)], "v array<double>").coalesce(1)
    got = [r[0] for r in df.select(vec.l2_normalise("v")).collect()]
    assert got == [[0.6, 0.8], None, [], [1e-13, 0.0]]


def test_candidates_with_several_keys_are_counted_once(spark):
    bases = F.array(*[F.lit(b) for b in ("/work", "/runs/r/evaluation", "/runs/r")])
    scores = spark.createDataFrame([("r", "1", "out/a.png", 0.4)], "run string, item_id string, path string, centroid_score double")
    styles = spark.createDataFrame([("r", "x", "/runs/r/out/a.png", 0.6), ("r", "y", "out/b.png", 0.1)], "run string, item_id string, path string, style_score double")
    gate = spark.createDataFrame([("r", "g", "/work/out/a.png", True, "fine")], "run string, item_id string, path string, qa_pass boolean, reason string")
    got = runs.candidate_table(*(runs.with_keys(f, bases) for f in (scores, styles, gate)), ["run"]).orderBy("path").collect()
    assert [(r["path"], r["centroid_score"], r["style_score"], r["qa_pass"]) for r in got] == [("out/a.png", 0.4, 0.6, True), ("out/b.png", None, 0.1, None)]


def test_models_held_or_joined_score_alike(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(str(i), f"p{i}", "ab"[i % 2], rng.normal(size=5).tolist()) for i in range(30)] + [("x", "px", "a", None), ("y", "py", "b", [1.0])]
    items = spark.createDataFrame(rows, "item_id string, path string, g string, embedding array<double>")
    models = centroids.centroid_models(items.where("size(embedding) = 5"), ["g"])

    def answers():
        scored = scoring.score_items(items, models, ["g"]).select("item_id", *scoring.SCORE_COLUMNS).orderBy("item_id").collect()
        return [tuple(r)[1:] for r in scored]

    held = answers()
    real = scoring.held_models
    monkeypatch.setattr(scoring, "held_models", lambda m, by: real(m, by, -1))
    joined = answers()
    assert [[v is None for v in r] for r in held] == [[v is None for v in r] for r in joined]
    flat = lambda rows: [v for r in rows for v in r if v is not None]
    assert np.allclose(flat(held), flat(joined))


@pytest.mark.parametrize("rows", [2, 3, 6, 999, 10_000])
@pytest.mark.parametrize("width", [5, 32, 64])
def test_equal_vectors_tie_wherever_they_lie_in_a_batch(rows, width):
    vector, mean, median = np.random.default_rng(rows + width).normal(size=(3, width))
    columns = scoring._against(np.tile(vector, (rows, 1)), mean, median)
    columns.append(vec.row_sums(np.tile(vector, rows), np.arange(rows + 1) * width))
    assert [len(np.unique(c)) for c in columns] == [1] * len(columns)


def test_candidates_of_equal_vectors_are_ordered_by_path(spark):
    vector, mean, median = (v.tolist() for v in np.random.default_rng(7).normal(size=(3, 64)))
    items = spark.range(0, 999, 1, 1).select(
        F.lit("r").alias("run"), F.col("id").cast("string").alias("item_id"), F.format_string("/out/%04d.png", F.lit(998) - F.col("id")).alias("path"),
        F.array(*map(F.lit, vector)).alias("embedding"),
    )
    model = spark.createDataFrame([(mean, median)], "mean_embedding array<double>, median_embedding array<double>")
    rows = runs.with_keys(scoring.score_items(items, model), F.array(F.lit("/")))
    styles = rows.select("run", "item_id", "path", "path_key", F.col("centroid_score").alias("style_score"))
    gate = rows.select("run", "item_id", "path", "path_key", F.lit(True).alias("qa_pass"), F.lit("fine").alias("reason"))
    got = runs.rank_candidates(runs.candidate_table(rows, styles, gate, ["run"]), ["run"]).orderBy("position").collect()
    assert [r["path_key"] for r in got] == [f"/out/{i:04d}.png" for i in range(999)]


def test_null_scores_in_blocks_summed_up_and_looked_up(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = {"a": rng.normal(size=(2, 5)), "b": rng.normal(size=(2, 5)), None: rng.normal(size=(2, 3)), "zero": np.zeros((2, 4))}
    rows = [(g, *v.tolist()) for g, v in vectors.items()] + [("none", None, [1.0]), ("empty", [], []), ("uneven", [1.0, 2.0], [1.0])]
    models = spark.createDataFrame(rows, "g string, mean_embedding array<double>, median_embedding array<double>")
    monkeypatch.setattr(resampling, "NULL_BLOCK", 16)
    monkeypatch.setattr(resampling, "SAMPLES_AT_ONCE", 7)

    def cosine(x, y):
        return x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) if (y @ y) > 0 else 0.0

    want = {}
    for g, (mean, median) in vectors.items():
        samples = resampling._normals(np.arange(50), len(mean), 9)
        want[g] = [(cosine(x, mean) + cosine(x, median)) / 2 for x in samples]
    got = resampling.null_scores(models, ["g"], samples=50, seed=9).collect()
    assert len(got) == 200
    for row in got:
        assert abs(row["null_score"] - want[row["g"]][row["sample"]]) < 1e-12
    for block in (16, 64):  # several merged blocks, one block
        monkeypatch.setattr(resampling, "NULL_BLOCK", block)
        nulls = resampling.null_distribution(models, ["g"], samples=50, seed=9)
        found = {r["g"]: r for r in resampling.null_summary(nulls, ["g"]).collect()}
        assert len(found) == 7 and found["none"]["sample_count"] == 0 and found["empty"]["p50"] is None and found["uneven"]["null_mean"] is None
        for g, scores in want.items():
            expected = [np.mean(scores), np.std(scores), *np.quantile(scores, [0.5, 0.9, 0.95, 0.99])]
            assert found[g]["sample_count"] == 50 and np.allclose(list(found[g])[2:], expected, atol=1e-6)
        observed = spark.createDataFrame([("a", 0.1, None), (None, 9.0, -9.0), ("none", 0.0, 0.0)], "g string, s double, t double")
        shares = {r["g"]: tuple(r)[1:] for r in resampling.observed_percentiles(nulls, observed, ["g"], ["s", "t"]).collect()}
        assert shares["a"] == (round(np.mean(np.array(want["a"]) <= 0.1), 6), None) and shares[None] == (1.0, 0.0) and shares["none"] == (None, None)
    assert resampling.null_summary(resampling.null_distribution(models.limit(0), ["g"]), ["g"]).count() == 0
    drawn = resampling._normals(np.arange(20000), 3, 1)
    assert abs(drawn.mean()) < 0.02 and abs(drawn.std() - 1) < 0.02


def test_digest_and_preview_write_halves_as_c_does(spark):
    """From the exact value: 2^-7 is a half at six decimals and goes to the even digit, 3.5e-6 lies below one, -1e-9 keeps its sign."""
    import hashlib

    values = [0.0078125, 0.0234375, 3.5e-6, -1e-9, 0.25, -3.0, 1e20]
    df = spark.createDataFrame([(1, values), (2, None)], "k int, v array<double>")
    got = {r["k"]: r for r in centroids.vector_summary(df, ["k"], "v").collect()}
    want = ["0.007812", "0.023438", "0.000003", "-0.000000", "0.250000", "-3.000000", "100000000000000000000.000000"]
    assert got[1]["digest"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert ["%.6f" % x for x in got[1]["preview"]] == want and got[2]["digest"] is None and got[2]["preview"] is None
