import random
from itertools import combinations

import llm_cases
import numpy as np
import pytest
from parity import compare, duck

from cohortlens.llm import minhash, texts
from cohortlens.llm.components import components
from cohortlens.llm.queries import ORACLES, QUERIES


def grams(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for space in "\t\n\v\f\r":
        w = w.replace(space, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def brute(rows):
    """(doc_id, text) -> n_shingles, component."""
    sets = [(i, grams(t)) for i, t in rows if i is not None]
    links = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if a != b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return roots({i for i, _ in sets}, links)


def test_against_sql(spark, folder):
    assert compare(spark, duck(folder), "op1", QUERIES["op1_minhash_near_dedup"], ORACLES["op1_minhash_near_dedup"], folder)[0] is None


def test_edges(spark):
    rows = [(r[0], r[1]) for r in llm_cases.rows()]
    want = brute(rows)
    got = minhash.near_groups(llm_cases.documents(spark)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, want.get(i)) for i, _ in rows}
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    sizes = {(i, len(grams(t))) for i, t in rows}
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == sizes
    assert minhash.near_groups(llm_cases.empty(spark)).count() == 0


def test_keep_one(spark):
    docs = llm_cases.documents(spark)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute([(r[0], r[1]) for r in llm_cases.rows()])
    assert {r["doc_id"] for r in kept.collect()} == {None} | {i for i, c in want.items() if i == c}


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_families_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for family in range(6):
        text = llm_cases.words(seed * 100 + family, rng.randrange(40, 160))
        for _ in range(14):
            text = list(text)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(docs).collect()}
    assert got == brute(rows)
    blocks = minhash.BUCKET_BLOCK, minhash.LINK_BLOCK
    try:  # buckets and clusters dealt out in blocks give the same groups
        minhash.BUCKET_BLOCK = minhash.LINK_BLOCK = 3
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_groups(docs).collect()} == got
    finally:
        minhash.BUCKET_BLOCK, minhash.LINK_BLOCK = blocks


def test_few_documents_take_few_tasks(spark):
    """Every task writes files of its own; on few documents they took more disk than the rows in them."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    text = [" ".join(llm_cases.words(i // 3, 60)) + f" {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    context = spark.sparkContext
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        context.setJobGroup("few", "few documents")
        kept = minhash.keep_one(docs).collect()
    finally:
        context._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds}
    ran = [i for i in map(tracker.getStageInfo, stages) if i and i.numCompletedTasks]
    assert {r["doc_id"] for r in kept} == set(range(0, 60, 3))
    assert sum(i.numCompletedTasks for i in ran) < 64 * 30, sum(i.numCompletedTasks for i in ran)


def test_pigeonhole_guarantee():
    config = minhash.Signature()
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**16, (200, config.size), np.uint16)
    other = base.copy()
    for row in other:  # as far apart as is guaranteed to meet
        at = rng.choice(config.size, config.guaranteed, replace=False)
        row[at] ^= np.uint16(1)
    a, b = minhash.chunk_keys(base, config), minhash.chunk_keys(other, config)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))


def test_links_at_the_threshold_survive_the_sketches():
    config, rng, lost = minhash.Signature(), np.random.default_rng(9), 0
    for _ in range(400):
        n = int(rng.integers(20, 900))
        pool = np.unique(rng.integers(0, 2**64, 8 * n, np.uint64))
        rng.shuffle(pool)
        common, extra = pool[: 6 * n // 2], pool[6 * n // 2 :]
        side = n // 2
        a, b = np.sort(np.concatenate((common, extra[:side]))), np.sort(np.concatenate((common, extra[side : 2 * side])))
        if 100 * len(common) < 75 * (len(common) + 2 * side):
            continue
        args = [x for f in (lambda g: np.array([len(g)]), lambda g: minhash.bin_sketch(g, config)[None]) for x in (f(a), f(b))]
        lost += not minhash.plausible(*args, config, 75)[0]
    assert lost == 0


def test_components(spark):
    rng = random.Random(3)
    nodes = range(300)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(nodes, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: want[n] for n in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_of_short_and_long_texts():
    assert len(texts.shingles(None)) == len(texts.shingles(" \t\x0b ")) == 0
    assert len(texts.shingles("a b c")) == 1 and len(texts.shingles("a b c d e f")) == 2
    assert (texts.shingles("A B c D e") == texts.shingles("a\nb c\rd e")).all()
