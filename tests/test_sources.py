"""Files and pages: scans, broken items, manifests, link and media parsing."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import pixels
from cohortlens.operators.engagement import clean_count, first_usable
from cohortlens.sources import files, pages


def png(path, rgb):
    """Minimal PNG writer for 8-bit RGB arrays."""
    height, width, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[y].astype(np.uint8).tobytes() for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def image_folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("items")
    rng = np.random.default_rng(0)
    for subject in ("a", "b"):
        (root / subject).mkdir()
        for i in range(2):
            png(root / subject / f"{i}.PNG" if i else root / subject / "0.png", rng.integers(0, 256, (48, 32, 3)))
    (root / "a" / "broken.png").write_bytes(b"not an image")
    (root / "a" / "notes.txt").write_text("skip")
    return root


def test_scan_and_subjects(spark, image_folder):
    rows = files.item_files(spark, str(image_folder)).collect()
    assert len(rows) == 5 and all(not r["path"].endswith(".txt") for r in rows)
    df = spark.createDataFrame([("/r/a/b/x.png",), ("/r/solo.name.png",)], "p string")
    assert [r[0] for r in df.select(files.subject_of_path(F.col("p"), "/r")).collect()] == ["a", "solo.name"]
    names = spark.createDataFrame([("slug_0123456789.jpg",), ("0001_my_slug_0123456789.png",), ("other.png",), ("x_short.png",)], "n string")
    assert [r[0] for r in names.select(files.subject_of_file_name(F.col("n"))).collect()] == ["slug", "my_slug", None, None]


def test_items_become_vectors_and_broken_ones_are_kept(spark, image_folder):
    decoded = files.item_pixels(spark, str(image_folder))
    rows = pixels.vectorise_items(decoded, ["path"]).collect()
    good = [r for r in rows if r["reason"] is None]
    bad = [r for r in rows if r["reason"] is not None]
    assert len(good) == 4 and len(bad) == 1 and bad[0]["embedding"] is None and bad[0]["luminance"] is None
    for r in good:
        assert len(r["embedding"]) == pixels.EMBEDDING_WIDTH and np.linalg.norm(r["embedding"]) == pytest.approx(1.0)
        assert len(r["appearance"]) == 64 * 64 * 3 and 0 <= min(r["appearance"]) and max(r["appearance"]) <= 1
        grey = np.array(r["grey"]).reshape(32, 32)
        assert r["luminance"] == pytest.approx(grey.mean(), abs=1e-6) and r["contrast"] == pytest.approx(grey.std(), abs=1e-6)
        assert r["warmth"] == pytest.approx(np.array(r["appearance"])[0::3].mean() - np.array(r["appearance"])[2::3].mean(), abs=1e-6)


def test_flat_image_is_only_centred():
    grey = np.full((1, 32, 32), 0.4)
    assert np.allclose(pixels.standardised(grey), 0.0)
    flat = np.full((40, 40, 3), 128.0)
    assert np.allclose(pixels.resized(flat, 64, pixels._lanczos, 3.0), 128.0)
    with pytest.raises(ValueError):
        pixels.vectorise_items(None, [], crop="other")


def test_histograms_match_numpy():
    rng = np.random.default_rng(2)
    rgb, grey = rng.random((3, 8, 8, 3)), rng.random((3, 8, 8))
    for i, row in enumerate(pixels.colour_histogram(rgb)):
        parts = np.concatenate([np.histogram(rgb[i, :, :, c], 8, (0, 1), density=True)[0] for c in range(3)])
        assert np.allclose(row, parts / np.linalg.norm(parts))
    for i, row in enumerate(pixels.edge_features(grey)):
        gy, gx = np.gradient(grey[i])
        m = np.hypot(gx, gy)
        hist = np.histogram((np.arctan2(gy, gx) + np.pi) / (2 * np.pi), 8, (0, 1), weights=m)[0]
        want = np.concatenate([hist, [m.mean(), m.std(), np.percentile(m, 75), np.percentile(m, 90)]])
        assert np.allclose(row, want / np.linalg.norm(want))


def test_manifest_blank_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"subject": "a", "handles": {"x": "1"}}\n\n   \n{"subject": "b", "handles": {}}\n', encoding="utf-8")
    rows = files.read_manifest(spark, str(tmp_path), "subject string, handles map<string,string>").where("subject is not null").collect()
    assert sorted(r["subject"] for r in rows) == ["a", "b"]


def test_score_sheet_with_mark_and_blank_score(spark, tmp_path):
    text = "﻿item_id,path,cosine_to_mean,cosine_to_median,euclidean_to_mean,euclidean_to_median,centroid_score\n\"a\",\"/p\",0.1,0.2,1,1,0.15\n\"b\",\"/q\",,,,,\n"
    (tmp_path / "s.csv").write_text(text, encoding="utf-8")
    rows = files.read_score_sheet(spark, str(tmp_path)).collect()
    assert [(r["item_id"], r["centroid_score"]) for r in rows] == [("a", 0.15)]


INDEX = """<html><body><!-- <a href="/talents/hidden/">h</a> --><script>var s='<a href="/talents/script/">';</script>
<a href="/talents/x/?q=1">1</a><a class="b" data-href="/no" href='https://site.example/talents/x#top'>2</a><a href=/talents/y>3</a>
<a href="https://other.example/talents/z/">4</a><a href="/talents/">5</a><a href="../talents/a&amp;b/">6</a><a title=">" href="mailto:x@y">7</a></body></html>"""


def test_site_links(spark):
    df = spark.createDataFrame([(1, "https://site.example/list/page", INDEX)], "id int, url string, html string")
    rows = sorted(pages.site_links(df, ["id"], "/talents/").collect(), key=lambda r: r["pos"])
    assert [r["link"] for r in rows] == ["https://site.example/talents/x/", "https://site.example/talents/y/", "https://site.example/talents/a&b/"]


PROFILE = """<html><head><title>Some Name | Site</title><meta name="description" content="生年月日 2007年6月25日"><meta property="og:image" content="/wp-content/uploads/a.jpg">
</head><body><img src="/wp-content/uploads/favicon.png"><IMG ALT='x &amp; y' SRCSET="https://site.example/wp-content/uploads/b.webp 2x, /c.png 1x"><a href="/wp-content/uploads/a.jpg">l</a></body></html>"""


def test_profile_and_media(spark):
    df = spark.createDataFrame([(1, "https://site.example/talents/some-name/", PROFILE)], "page_id int, url string, html string")
    row = pages.profiles(df, ["page_id"]).first()
    assert row["name"] == "Some Name" and str(row["birthdate"]) == "2007-06-25"
    media = sorted(pages.media_candidates(df, ["page_id"]).collect(), key=lambda r: r["pos"])
    assert [(m["media_url"], m["kind"], m["alt"]) for m in media] == [
        ("https://site.example/wp-content/uploads/a.jpg", "og:image", None), ("https://site.example/wp-content/uploads/b.webp", "img", "x & y")]
    manifest = pages.candidate_manifest(df, F.to_date(F.lit("2026-06-24")), 20).collect()
    assert {(m["slug"], m["age_as_of"], m["eligible"], m["exclusion_reason"]) for m in manifest} == {("some-name", 18, False, "under_min_age_20")}
    plan = pages.fetch_plan(pages.candidate_manifest(df, F.to_date(F.lit("2026-06-24")), 20, include_all=True), ["slug"], limit=1).collect()
    assert len(plan) == 1 and plan[0]["target"].startswith("some-name_") and plan[0]["status"] == "planned"


def test_body_date_is_the_last_resort(spark):
    df = spark.createDataFrame([(1, "u", "<title></title><p>2000年1月2日</p>")], "page_id int, url string, html string")
    row = pages.profiles(df, ["page_id"]).first()
    assert row["name"] is None and str(row["birthdate"]) == "2000-01-02"


def test_handles(spark):
    links = ["https://www.instagram.com/p/abc/", "https://www.instagram.com/Real.One/?hl=ja", "https://x.com/search?q=1", "https://twitter.com/person_1", "https://www.tiktok.com/@dance.er", "https://www.instagram.com/second/"]
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate(links)], "id int, pos int, href string")
    got = {r["channel"]: r["handle"] for r in pages.channel_handles(df, ["id"]).collect()}
    assert got == {"instagram": "Real.One", "twitter": "person_1", "tiktok": "dance.er"}


def test_resolve_url_forms(spark):
    cases = [("/x", "https://h.example/x"), ("?q", "https://h.example/a/b?q"), ("#f", "https://h.example/a/b#f"), ("c/../d", "https://h.example/a/d"),
             ("//o.example/z", "https://o.example/z"), ("javascript:void(0)", "javascript:void(0)"), ("http://[bad", None)]
    df = spark.createDataFrame([("https://h.example/a/b", link) for link, _ in cases], "base string, link string")
    assert [r[0] for r in df.select(pages.resolve_url("base", "link")).collect()] == [w for _, w in cases]


def test_markup_that_does_not_count(spark):
    html = (
        "<!-- <title>Old</title> 1990年1月1日 --><title>New</title><a title=\"use href=/wrong here\" href='/right/'>x</a>"
        "<p>１９９９年１２月０３日</p>"
    )
    df = spark.createDataFrame([(1, "https://h.example/", html)], "page_id long, url string, html string")
    row = pages.profiles(df, ["page_id"]).first()
    assert row["name"] == "New" and str(row["birthdate"]) == "1999-12-03"
    assert [r["link"] for r in pages.site_links(df, ["page_id"], "/").collect()] == ["https://h.example/right/"]


def test_numbers_beyond_the_range_are_null(spark):
    texts = ["99999999999999B followers", "１,２３４フォロワー", "12 followers"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(pages.follower_count(F.col("t"))).collect()] == [None, 1234, 12]
    assert [r[0] for r in spark.createDataFrame([("1e30",), ("1.2K",)], "t string").select(clean_count(F.col("t"))).collect()] == [None, 1200]


def test_existing_file_of_the_same_name_comes_first(spark):
    plan = spark.createDataFrame([("zed_0123456789.png", "planned"), ("new_aaaaaaaaaa.png", "planned")], "target string, status string")
    old = spark.createDataFrame([("aaa_0123456789.png",), ("zed_0123456789.png",), ("zed_0123456789.png",), ("b_aaaaaaaaaa.png",)], "file_name string")
    got = {r["target"]: r["status"] for r in pages.mark_existing(plan, old).collect()}
    assert got == {"zed_0123456789.png": "skipped", "b_aaaaaaaaaa.png": "skipped"}


def test_strict_channels_take_the_first_source_only_if_ok(spark):
    rows = [
        ("twitter", "a", 1, "partial", 5), ("twitter", "a", 2, "blocked", 7), ("twitter", "b", 1, "ok", 3), ("twitter", "b", 2, "ok", 4),
        ("twitter", "c", 1, "blocked", None), ("twitter", "c", 2, "blocked", None), ("tiktok", "a", 1, "partial", 5), ("tiktok", "a", 2, "ok", 6),
    ]
    df = spark.createDataFrame(rows, "channel string, handle string, priority int, fetch_status string, followers long")
    got = {(r["channel"], r["handle"]): r["priority"] for r in first_usable(df, ["channel", "handle"]).collect()}
    assert got == {("twitter", "a"): 2, ("twitter", "b"): 1, ("twitter", "c"): 1, ("tiktok", "a"): 1}


def test_a_subject_folder_has_one_file(spark, tmp_path):
    """However many tasks hold rows of a subject; rows without a subject are left out."""
    rows = spark.range(0, 4000, 1, 16).selectExpr("id", "CASE WHEN id % 7 > 0 THEN concat('s', id % 7) END AS subject")
    files.write_by_subject(rows, str(tmp_path / "out"))
    found = {f.name: len(list(f.glob("*.parquet"))) for f in (tmp_path / "out").glob("subject=*")}
    assert found == {f"subject=s{k}": 1 for k in range(1, 7)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.where("subject is not null").count()


def test_a_subject_is_worked_out_once_per_row(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def subject(k):
        calls.add(1)
        return f"s{k % 7}" if k % 7 else None

    rows = spark.range(0, 1000, 1, 4).withColumn("subject", F.udf(subject, "string")("id"))
    files.write_by_subject(rows, str(tmp_path / "out"))
    assert calls.value == 1000
    assert files.read_by_subject(spark, str(tmp_path / "out"), rows.schema).count() == 1000 - len(range(0, 1000, 7))


def test_few_bytes_in_many_folders_are_written_by_all_cores(spark, tmp_path):
    rows = spark.range(400).selectExpr("id", "concat('s', id) AS subject")
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    files.write_by_subject(rows, str(tmp_path / "out"))
    written = [f.name for f in (tmp_path / "out").glob("subject=*/part-*.parquet")]
    assert len(written) == 400 and len({name.split("-")[1] for name in written}) >= spark.sparkContext.defaultParallelism
    assert spark.conf.get(setting) == before


def test_folders_are_listed_by_a_few_tasks_and_keep_their_names(spark, tmp_path):
    rows = spark.range(80).selectExpr("id", "lpad(id, 3, '0') AS subject")
    files.write_by_subject(rows, str(tmp_path / "out"))
    setting, group = "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(tmp_path)
    before, context = spark.conf.get(setting), spark.sparkContext
    context.setJobGroup(group, "listing")
    back = files.read_by_subject(spark, str(tmp_path / "out"), rows.schema)
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * context.defaultParallelism < 80 and spark.conf.get(setting) == before
    assert sorted(map(tuple, back.select("id", "subject").collect())) == [(k, f"{k:03}") for k in range(80)]


def test_no_row_with_a_subject_gives_no_rows(spark, tmp_path):
    rows = spark.range(5).selectExpr("id", "cast(NULL AS string) AS subject")
    files.write_by_subject(rows, str(tmp_path / "out"))
    assert files.read_by_subject(spark, str(tmp_path / "out"), rows.schema).count() == 0


def test_manifest_order_of_pages_that_share_an_address(spark):
    columns = ["slug", "media_url", "profile_url", "kind", "alt"]
    rows = spark.range(0, 200, 1, 13).selectExpr("(id * 37) % 200 AS page_id", *[f"'{c}' AS {c}" for c in columns])
    placed = pages.ordered_manifest(rows).select("page_id", "position").collect()
    assert all(r["position"] == r["page_id"] + 1 for r in placed)
