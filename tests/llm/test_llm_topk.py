import math
import random

import pytest
from parity import compare, duck
from pyspark.sql import functions as F

from cohortlens.llm import topk
from cohortlens.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<double>, length double, vector int, query string, rank int, score long"
EXTRA = (1.0, 2, "q", 3, 4)  # columns whose names clash with names used inside


def table(spark, made):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in made], SCHEMA)


def brute(made, k=5, every=50):
    rows = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in made if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in rows:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), c) for c, v in rows if c != i and len(v) == len(q))
            out += [(i, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def got(spark, made, parts=4, **options):
    df = topk.top_products(table(spark, made).repartition(parts), F.col("vec_id") % 50 == 0, **options)
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def vectors(seed, n, width, spread):
    rng = random.Random(seed)
    return [(i - 20, [rng.gauss(0, 1) * rng.choice(spread) for _ in range(width)]) for i in range(n)]


def test_against_sql(spark, folder):
    name = "op12_exact_topk"
    assert compare(spark, duck(folder), name, QUERIES[name], ORACLES[name], folder)[0] is None


def test_against_brute_force(spark, monkeypatch):
    made = vectors(1, 600, 8, [0.1, 1, 5])
    made += [(1000 + i, made[30][1]) for i in range(120)]  # one vector many rows share, some of them queries
    made += [(2000 + i, [x * (1 + i / 1000) + 0.01 for x in made[30][1]]) for i in range(120)]  # and others close to it
    assert got(spark, made) == brute(made)
    monkeypatch.setattr(topk, "BUCKET", 16)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "SEEDS", 7)
    monkeypatch.setattr(topk, "CHUNK_BYTES", 200)  # several chunks
    assert got(spark, made) == brute(made)


def test_coordinates_prune_only_what_cannot_reach():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(-200, 200, (1, 12))
    whole = np.concatenate((base + rng.integers(-70, 70, (300, 12)), rng.integers(-230, 230, (300, 12))))
    length = np.sqrt((whole * whole).sum(axis=1).astype(float))
    order = np.argsort(-length)
    whole, length, ids = whole[order], length[order], np.arange(600)
    query = np.concatenate((base, whole[[5, 99]]))
    owners = (-1, 5, 99)
    want = [sorted((-int(s), int(i)) for i, s in enumerate(whole @ row) if i != own)[:5] for row, own in zip(query, owners)]
    best = topk.Best(np.array(owners), query, np.sqrt((query * query).sum(axis=1).astype(float)), np.array([-w[-1][0] for w in want]), 5)
    coordinates = []
    real = topk.Best._by_coordinates
    best._by_coordinates = lambda *a: coordinates.append(1) or real(best, *a)
    for at in range(0, 600, 50):
        best.bucket(ids[at : at + 50], whole[at : at + 50], length[at : at + 50])
    for row in range(3):
        assert [(-int(s), int(i)) for s, i in zip(best.scores[row], best.found[row])] == want[row]
    assert coordinates


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    made = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (50, None), (100, [None, 1.0]), (150, [inf, 1.0]), (200, [nan, 1.0]), (None, [9.0, 9.0])]
    made += [(250, []), (251, []), (300, [0.0, 0.0]), (1, [1.0, -1.0]), (1, [1.0, -1.0]), (2, [1.0, -1.0]), (350, [1.0, 2.0, 3.0]), (-50, [-0.001, 0.0])]
    assert got(spark, made) == brute(made)
    assert got(spark, []) == []
    assert got(spark, [(50, [1.0])]) == []
    assert got(spark, made, parts=1, k=1) == brute(made, k=1)


def test_large_components_stay_exact(spark):
    made = [(i * 50 if i < 3 else i, [float(2**20 + i), 0.5 + 2.0**15 * i, -float(i)]) for i in range(40)]
    assert got(spark, made) == brute(made)
    with pytest.raises(Exception, match="64 bits|too large|too big"):
        got(spark, [(0, [1e300]), (1, [1e300])])
