import zlib

import llm_cases
import numpy as np
import pytest

from cohortlens.llm import quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(docs, quality.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    scores, marks = np.array([r["score"] for r in got]), np.array([r["quality"] for r in got])
    below = (scores[marks == 0][:, None] < scores[marks == 1][None]).mean()
    assert below >= 0.9 and np.mean(np.array([r["predicted"] for r in got]) == marks) >= 0.93
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_edges(spark):
    model = quality.train(["good text here", "BAD!! BAD!!"] * 20, [1, 0] * 20)
    got = quality.scored(llm_cases.documents(spark), model).collect()
    assert len(got) == len(llm_cases.rows()) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[4]["score"] == by[5]["score"] == by[6]["score"]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert quality.scored(llm_cases.empty(spark), model).count() == 0


def test_nothing_to_learn(spark):
    docs = llm_cases.documents(spark)
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    assert {r["score"] for r in quality.scored(docs, quality.fit(docs, labels)).collect()} == {0.5}


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(40)], "doc_id long, text string")
    marks = [(i, i % 2) for i in range(40)]
    spoiled = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in marks]
    a, b = (quality.fit(docs, spark.createDataFrame(m, "doc_id long, quality int")) for m in (marks, spoiled))
    assert (a.weights == b.weights).all() and a.bias == b.bias


@pytest.mark.parametrize("text", ["", " ", "a", "ab cd", "x " * 50, "ü日本 é"])
def test_features_do_not_depend_on_neighbours(text):
    alone = sorted(quality._features([text.encode()])[1].tolist())
    owners, buckets = quality._features([b"before this", text.encode(), b"after that"])
    assert sorted(buckets[owners == 1].tolist()) == alone


def test_features_against_brute_force():
    """As many features as words, repeats, and n-grams of each word with its marked ends."""
    text = "the the cat sat a"
    want = sum(1 + sum(max(0, len(w) + 2 - n + 1) for n in quality.GRAMS) for w in text.split()) + 1
    spaced = sum(1 for n in quality.GRAMS for w in text.split() if len(w) + 2 < n)
    assert spaced == 1 and len(quality._features([text.encode()])[1]) == want  # "a" has no 4-gram
