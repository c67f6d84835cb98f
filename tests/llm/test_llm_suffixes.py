import hashlib
import random

import llm_cases
import numpy as np
import pytest

from cohortlens.llm import suffixes
from cohortlens.llm.queries import QUERIES

N = suffixes.LENGTH


def brute(rows):
    """(doc_id, text) rows -> n_bytes, n_removed, n_spans, kept digest of each."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        if doc is not None:
            for i in range(len(data) - N + 1):
                w = data[i : i + N]
                first[w] = min(first.get(w, doc), doc)
    result = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - N + 1):
            if doc is not None and first[data[i : i + N]] < doc:
                gone[i : i + N] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[: len(data)]])
        result.append((doc, len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return result


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_query_against_brute_force(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert order(QUERIES["op8_suffix_array_dedup"](spark, folder).collect()) == order(brute(rows))


def test_edges(spark):
    rows = llm_cases.rows()
    got = suffixes.remove_repeats(llm_cases.documents(spark)).collect()
    assert order(got) == order(brute([r[:2] for r in rows]))
    assert suffixes.remove_repeats(llm_cases.empty(spark)).count() == 0
    whole = suffixes.remove_repeats(llm_cases.documents(spark), with_text=True).where("doc_id = 12").first()
    assert whole["kept"] is not None and sum(b - a for a, b in whole["spans"]) == whole["n_removed"] > 0


@pytest.mark.parametrize("seed", range(3))
def test_passages_at_every_place(spark, seed):
    rng = random.Random(seed)
    letters = "ab" if seed == 0 else "abcdé "
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(45, 130))) for _ in range(8)] + ["x" * 70, "ab" * 60]
    rows = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages)
            a = rng.randrange(0, 12)
            parts += [p[a : len(p) - rng.randrange(0, 12)], "".join(rng.choice("qrstuv") for _ in range(rng.randrange(0, 30)))]
        rows.append((len(rows), "".join(parts)))
    rng.shuffle(rows)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order(got) == order(brute(rows))


def test_texts_over_a_slice(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh") for _ in range(2 * suffixes.SLICE + 777))
    cut = suffixes.SLICE - 30
    rows = [(1, long), (2, "zz" + long[cut : cut + 200] + "yy"), (3, long[5:] + "end"), (4, long[-60:])]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {1: 0, 2: 200, 3: len(long) - 5, 4: 60}
    assert {r["doc_id"]: r["n_removed"] for r in got} == want


def test_family_levels_stay_few_and_exact():
    rng = np.random.default_rng(1)
    keys, docs = rng.integers(0, 3000, 20_000).astype(np.uint64), rng.integers(0, 500, 20_000)
    earliest = {}
    for k, d in zip(keys.tolist(), docs.tolist()):
        earliest[k] = min(d, earliest.get(k, d))
    assert suffixes.scan(keys, docs, batch=64).tolist() == [earliest[k] for k in keys.tolist()]
    family = suffixes.Family()
    for start in range(0, 6400, 64):
        family.add(np.arange(start, start + 64, dtype=np.uint64), np.full(64, start))
    sizes = [len(level) for level, _ in family.levels]
    assert sum(sizes) == 6400 and all(2 * b < a for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 8
