"""Packing tokenised documents into as few full sequences as possible: a configuration LP over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import cut_lineage, row_numbers
from . import texts, tokens

CAPACITY = 2_048  # tokens of a sequence
END_ID = 0  # id after every document
ROUNDS = 1_000  # weight updates of the linear program
STEEPNESS = 8.0  # how strongly a covered length loses weight

Pattern = tuple[dict[int, int], int]  # pieces of each length in a sequence, and how many such sequences


def pieces(documents: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, json_path: str = tokens.JSON_PATH, ranks_path: str = tokens.RANKS_PATH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every document's pieces.

    A document is its ids and one end id; only a document over ``capacity`` is cut, so that all pieces but the first are full.
    """

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, body in zip(batch.column(0).to_pylist(), tokens.encoder(json_path, ranks_path).encode(batch.column(1))):
            ids = np.append(body, np.uint32(END_ID)).astype("<u4")
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
            for i, (start, end) in enumerate(zip(cuts[:-1], cuts[1:])):
                out["doc_id"].append(doc)
                out["piece"].append(i)
                out["start"].append(start)
                out["length"].append(end - start)
                out["ids_crc32"].append(zlib.crc32(ids[start:end].tobytes()))
                if with_ids:
                    out["ids"].append(ids[start:end])
        yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return texts.map_batches(documents.select(F.col("doc_id").cast("long"), "text"), kernel, schema)


def knapsack(values: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths with the highest total value that fits ``capacity``; ``values[l]`` is the value of length l."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gains = best[room - 1 :: -1] + values[1 : room + 1]
        length = int(gains.argmax()) + 1
        if gains[length - 1] > best[room - 1]:
            best[room], choice[room] = gains[length - 1], length
        else:
            best[room] = best[room - 1]
    pattern: dict[int, int] = {}
    room = capacity
    while room > 0:
        if choice[room]:
            pattern[int(choice[room])] = pattern.get(int(choice[room]), 0) + 1
            room -= int(choice[room])
        else:
            room -= 1
    return pattern


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths within their counts that add up as close to ``room`` as can be, larger ones preferred (subset sums)."""
    reached = np.full(room + 1, -1)
    reached[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        n, times = min(counts[length], room // length), 1
        while n > 0 and reached[room] < 0:
            times = min(times, n)
            width = length * times
            fresh = (reached[: room + 1 - width] >= 0) & (reached[width:] < 0)
            if fresh.any():
                items.append((length, times))
                reached[width:][fresh] = len(items) - 1
            n, times = n - times, 2 * times
        if reached[room] >= 0:
            break
    pattern: dict[int, int] = {}
    at = int(np.flatnonzero(reached >= 0)[-1])
    while at > 0:
        length, times = items[reached[at]]
        pattern[length] = pattern.get(length, 0) + times
        at -= length * times
    return pattern


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[Pattern]:
    """Fill sequences for a histogram of lengths: patterns whose pieces add up to the histogram exactly.

    The configuration LP (least number of sequences covering every length's count) by multiplicative weights: each length
    has a weight that falls as it gets covered; the pattern worth most under the weights comes from the knapsack's dynamic
    program and is used as often as its scarcest length allows.  Counts are rounded down to what is still there, and what
    is left over is filled from the largest length down, each time with the lengths that fill the rest of the sequence
    best, as often as the counts allow, so every step uses up a length.  The histogram has at most ``capacity`` lengths;
    nothing here grows with the rows.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.zeros(capacity + 1)
    counts[lengths] = [histogram[int(x)] for x in lengths]
    covered = np.zeros(capacity + 1)
    chosen: dict[tuple[tuple[int, int], ...], float] = {}
    small = lengths[lengths < capacity]
    for _ in range(min(rounds, 2 * len(small))):
        values = np.full(capacity + 1, -1.0)
        share = covered[small] / counts[small]
        # a sequence of one length alone is worth its share of the capacity: weights stay near the lengths' own prices
        values[small] = small / capacity * np.exp(-STEEPNESS * (share - share.min()))
        pattern = {x: n for x, n in knapsack(values, capacity).items() if n}
        if not pattern:
            break
        step = min(counts[x] / n for x, n in pattern.items())
        for x, n in pattern.items():
            covered[x] += n * step
        key = tuple(sorted(pattern.items()))
        chosen[key] = chosen.get(key, 0.0) + step
    left = {int(x): int(histogram[int(x)]) for x in lengths}
    result: list[Pattern] = []
    scale = max(1.0, float((covered[small] / counts[small]).min())) if len(small) else 1.0

    def use(pattern: dict[int, int], at_most: float) -> None:
        times = int(min(at_most, min(left[x] // n for x, n in pattern.items())))
        if times > 0:
            result.append((pattern, times))
            for x, n in pattern.items():
                left[x] -= n * times

    full = lambda key: sum(x * n for x, n in key)
    for key, amount in sorted(chosen.items(), key=lambda item: (-full(item[0]), -item[1])):
        use(dict(key), amount / scale)
    while any(left.values()):
        largest = max(x for x, n in left.items() if n)
        left[largest] -= 1
        pattern = fill(left, capacity - largest)
        left[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        use(pattern, float("inf"))
    return result


def _places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: per (length, pattern) the first rank it takes, and what that rank gets."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            first = taken.get(length, 0)
            rows.append((length, first, n, sequence, offset))
            taken[length] = first + n * times
            offset += n * length
        sequence += times
    columns = np.array(sorted(rows) or np.empty((0, 5)), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "n", "sequence", "offset"), columns.T))


def pack(
    documents: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, with_ids: bool = False,
    json_path: str = tokens.JSON_PATH, ranks_path: str = tokens.RANKS_PATH,
) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Sequences are filled from offset 0 without gaps and never beyond ``capacity``.  Null text counts as empty: its one
    token is the end id.  Rows that repeat are packed as often as they are given; rows without doc_id are packed too.
    Other columns are ignored; an empty table gives an empty result.  Pieces of one length are interchangeable: they are
    ranked by (doc_id, piece) across range partitions, and a rank finds its sequence in a table of patterns whose size
    depends on ``capacity`` and ``rounds`` alone.
    """
    cut = cut_lineage(pieces(documents, capacity, with_ids, json_path, ranks_path))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = _places(configurations(histogram, capacity, rounds))
    names = cut.columns
    ranked = row_numbers(cut, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank")

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        length, rank = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "rank"))
        rank = rank - 1
        wide = np.int64(2**50)  # ranks stay below
        at = np.searchsorted(places["length"] * wide + places["first"], length * wide + rank, side="right") - 1
        place = rank - places["first"][at]
        times, within = np.divmod(place, places["n"][at])
        yield {name: batch.column(name) for name in names} | {
            "sequence_id": places["sequence"][at] + times, "offset": places["offset"][at] + within * length,
        }

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return texts.map_batches(ranked.select(*names, "rank"), kernel, schema + ", sequence_id long, offset long")
