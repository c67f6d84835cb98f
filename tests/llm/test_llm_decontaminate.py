import random
import time

import llm_cases
import numpy as np
import pytest

from cohortlens.llm import decontaminate


def naive_tiling(pattern, text, least):
    """Greedy string tiling by comparing every pair of positions."""
    marked = [[False] * len(pattern), [False] * len(text)]
    covered = 0
    while True:
        best, found = least - 1, []
        for t in range(len(text)):
            for p in range(len(pattern)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not marked[0][p + n] and not marked[1][t + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, t)]
                elif n == best:
                    found.append((p, t))
        if best < least:
            return covered
        for p, t in found:
            if not any(marked[0][p : p + best]) and not any(marked[1][t : t + best]):
                marked[0][p : p + best] = marked[1][t : t + best] = [True] * best
                covered += best


@pytest.mark.parametrize("seed", range(15))
def test_tiling_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    pattern, text = (rng.integers(1, 4 + seed % 4, int(n)).astype(np.uint64) for n in rng.integers(1, 50, 2))
    tiles = decontaminate.tile(pattern, text, 3)
    assert sum(n for _, _, n in tiles) == naive_tiling(pattern.tolist(), text.tolist(), 3)
    assert all((pattern[p : p + n] == text[t : t + n]).all() for p, t, n in tiles)


def tables(spark):
    item = llm_cases.words(50, 40)
    filler = llm_cases.words(51, 200)
    shuffled = item[25:] + ["x", "y"] + item[10:25] + ["z"] + item[:10]
    docs = [
        (1, " ".join(filler[:80] + item + filler[80:])), (2, " ".join(filler[:30] + shuffled + filler[30:])), (3, " ".join(filler)),
        (4, " ".join(filler + item[:12])), (5, None), (6, ""), (7, "Short, item HERE"), (8, " ".join(item).upper().replace(" ", ", ")),
        (1, " ".join(filler)), (None, " ".join(item)),
    ]
    bench = [(10, " ".join(item)), (11, "short item here"), (12, None), (13, ""), (14, " ".join(item)), (None, " ".join(llm_cases.words(52, 30)))]
    wide = [d + llm_cases.EXTRA for d in docs]
    schema = llm_cases.SCHEMA.replace("lang string, source string, n_chars long, ", "")
    return spark.createDataFrame(wide, schema), spark.createDataFrame(bench, "item_id long, text string")


@pytest.mark.parametrize("seed_bytes", [2**24, 0])
def test_edges_and_reordered_passages(spark, seed_bytes):
    docs, bench = tables(spark)
    rows = decontaminate.contamination(docs, bench, seed_bytes=seed_bytes).collect()
    assert len(rows) == docs.count()
    assert {r["doc_id"] for r in rows if r["contaminated"]} == {1, 2, 7, 8}
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["item_id"] == 10 and by[2]["coverage"] == 1.0 and by[2]["n_items"] == 2 and by[7]["item_id"] == 11
    assert 0.25 < by[4]["coverage"] < 0.35 and by[5]["coverage"] == by[3]["coverage"] == 0.0 and by[3]["item_id"] is None
    nothing = decontaminate.contamination(docs, bench.limit(0), seed_bytes=seed_bytes).collect()
    assert len(nothing) == docs.count() and not any(r["contaminated"] for r in nothing)
    assert decontaminate.contamination(docs.limit(0), bench, seed_bytes=seed_bytes).count() == 0


def test_drop_contaminated(spark):
    docs, bench = tables(spark)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "6", "None"]


def test_query_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    want = set()
    for doc, text in texts.items():
        words = decontaminate.tokens(text)
        runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for item in items.values():
            pattern = decontaminate.tokens(item)
            if any(tuple(pattern[i : i + 5]) in runs for i in range(len(pattern) - 4)):
                near = [i for i in range(len(words) - 4) if tuple(words[i : i + 5]) in {tuple(pattern[j : j + 5]) for j in range(len(pattern) - 4)}]
                cut = words[min(near) : max(near) + 5]
                if naive_tiling(pattern, cut, 5) >= 0.6 * len(pattern):
                    want.add(doc)
    got = {r["doc_id"] for r in decontaminate.contamination(docs, bench).where("contaminated").collect()}
    assert got == want and want


def test_marked_words_are_not_used_twice():
    rng = random.Random(1)
    words = [rng.randrange(50) for _ in range(30)]
    pattern = np.array(words, np.uint64)
    tiles = decontaminate.tile(pattern, np.concatenate((pattern, pattern)), 5)
    assert sum(n for _, _, n in tiles) == 30


@pytest.mark.parametrize("gap", [10**9, 50])
def test_repetitive_texts_take_no_quadratic_steps(gap):
    def junk(n, breaks):
        words = np.full(n, 7, np.uint64)
        words[gap - 1 :: gap] = np.arange(len(words[gap - 1 :: gap])) + breaks
        return words

    pattern, text = junk(20_000, 1000), junk(20_000, 10**6)
    started = time.process_time()
    tiles = decontaminate.tile(pattern, text, 5)
    assert time.process_time() - started < 5
    assert sum(n for _, _, n in tiles) == (pattern == 7).sum()


@pytest.mark.parametrize("seed", range(8))
def test_tiling_with_equal_hashes_of_different_words(seed, monkeypatch):
    monkeypatch.setattr(decontaminate, "_FACTOR", 1)  # sums without places: every reordered run has the same hash
    rng = np.random.default_rng(seed)
    pattern, text = (rng.integers(1, 5, int(n)).astype(np.uint64) for n in rng.integers(10, 40, 2))
    tiles = decontaminate.tile(pattern, text, 3)
    assert all((pattern[p : p + n] == text[t : t + n]).all() for p, t, n in tiles)
    assert sum(n for _, _, n in tiles) == naive_tiling(pattern.tolist(), text.tolist(), 3)


def test_clashing_names_stay(spark):
    docs, bench = tables(spark)
    kept = decontaminate.drop_contaminated(docs.selectExpr("*", "1 AS __bad"), bench)
    assert kept.columns[-1] == "__bad" and kept.count() == 5


def test_runs_are_looked_up_without_sorting_the_seeds_for_each_document():
    """The same runs as a plain set gives, for no, few and many seeds; a document costs what its own runs cost."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 5000):
        seeds = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        known = decontaminate._Seeds(seeds)
        for runs in (np.empty(0, np.uint64), rng.integers(0, 2**64, 300, dtype=np.uint64), np.concatenate((seeds[::7], seeds[:3], seeds ^ np.uint64(1)))):
            assert known.among(runs).tolist() == sorted(set(runs.tolist()) & set(seeds.tolist()))
    known, runs = decontaminate._Seeds(np.sort(rng.integers(0, 2**64, 1_000_000, dtype=np.uint64))), rng.integers(0, 2**64, 500, dtype=np.uint64)
    start = time.perf_counter()
    for _ in range(200):
        known.among(runs)
    assert time.perf_counter() - start < 2
