import bisect
import zlib
from collections import defaultdict

import llm_cases
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import packing, tokens

HF = Tokenizer.from_file(tokens.JSON_PATH)


def test_ids_equal_the_tokenizer(spark):
    odd = [
        "it's we'll  x\n\n y \t z²³ 12½ naïve_foo __ ƒ", "a<|endoftext|>b <|endoftext|>", "日本語 text’s “quote” — é x\x1cy\xa0z", "  lead",
        "tail  ", "'S 's don't", "", "x ", "\nx", "a\nb c.\nD 'll", None, "nul\x00byte", " ", "\n", "a \n b",
    ]
    plain = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    got = list(tokens.encoder().encode(pa.array(odd + plain)))
    want = HF.encode_batch_fast([t or "" for t in odd + plain], add_special_tokens=False)
    assert [x.tolist() for x in got] == [w.ids for w in want]


def check_places(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_whole_pieces_and_places(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs).collect()
    ids = {r["doc_id"]: np.array(HF.encode(r["text"], add_special_tokens=False).ids + [0], "<u4") for r in docs.collect()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() == ids.keys()
    for doc, held in pieces.items():
        held.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in held] == list(range(len(held)))
        at = 0
        for r in held:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[doc][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[doc]) and all(r["length"] == 2048 for r in held[1:]) and (len(held) == 1 or at > 2048)
    used = check_places(rows, 2048)
    assert used <= -(-sum(map(len, ids.values())) // 2048) + 2


def test_edges(spark):
    docs = llm_cases.documents(spark)
    rows = packing.pack(docs, capacity=64, with_ids=True).collect()
    check_places(rows, 64)
    assert sum(r["piece"] == 0 for r in rows) == docs.count()
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == 1
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert packing.pack(llm_cases.empty(spark)).count() == 0


def best_fit_decreasing(lengths, capacity):
    rooms, used = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, x)
        used += at == len(rooms)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - x)
    return used


@pytest.mark.parametrize("seed", range(6))
def test_configurations_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 400)
    histogram = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
    used = defaultdict(int)
    patterns = packing.configurations(histogram, 100)
    for pattern, times in patterns:
        assert sum(x * n for x, n in pattern.items()) <= 100
        for x, n in pattern.items():
            used[x] += n * times
    assert used == histogram
    assert sum(t for _, t in patterns) <= 1.02 * best_fit_decreasing(lengths.tolist(), 100) + 1
    assert packing.configurations({}, 100) == [] and packing.configurations({100: 3}, 100) == [({100: 1}, 3)]


def test_linear_program_beats_first_fit_where_it_matters():
    # 51 + 27 + 22 fill a sequence; largest first would put 27 and 27 or 22s elsewhere
    histogram = {51: 60, 27: 60, 22: 60}
    assert sum(t for _, t in packing.configurations(histogram, 100)) <= 62


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        capacity, values = 23, np.full(24, -1.0)
        for x in rng.choice(np.arange(2, 23), 5, replace=False):
            values[x] = rng.random()
        best = [0.0] * 24
        for room in range(1, 24):
            best[room] = max([best[room - 1], *(best[room - x] + values[x] for x in range(1, room + 1))])
        pattern = packing.knapsack(values, capacity)
        assert sum(x * n for x, n in pattern.items()) <= capacity
        assert sum(values[x] * n for x, n in pattern.items()) == pytest.approx(best[capacity])
