"""Benchmark decontamination by greedy string tiling: copied passages are found in any order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import cut_lineage, small_side
from . import texts
from .texts import free_name

MIN_MATCH = 5  # words of the shortest tile, and of a seed
COVERAGE = 0.6  # share of a test item's words that tiles must cover
SEED_BYTES = 16 * 1024 * 1024  # seeds and item words a task may hold; a larger benchmark meets the documents by a join

_PUNCTUATION = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalnum()), b" " * sum(not chr(b).isalnum() for b in range(128)))


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()


def token_hashes(text: str | None) -> np.ndarray:
    return texts.word_hashes(tokens(text))


_FACTOR = 0x9E3779B97F4A7C15


class _Side:
    """One of the two sequences: its unmarked words and the hash of any run of them from running sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words, self.free = words, np.ones(n, bool)
        ones = np.ones(1, np.uint64)
        powers = np.cumprod(np.concatenate((ones, np.full(n, _FACTOR, np.uint64))))
        self.inverses = np.cumprod(np.concatenate((ones, np.full(n, pow(_FACTOR, -1, 2**64), np.uint64))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(texts.mix(words) * powers[:n])))

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every run of ``width`` unmarked words."""
        if len(self.words) < width:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        marked = np.concatenate(([0], np.cumsum(~self.free)))
        starts = np.flatnonzero(marked[width:] == marked[:-width])
        return starts, (self.sums[starts + width] - self.sums[starts]) * self.inverses[starts]


def tile(pattern: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences: (start in pattern, start in text, length), longest matches first.

    Each round looks for the longest match of unmarked words by running Karp-Rabin: hashes of all unmarked runs of the
    current length are looked up, and the length doubles while it matches or halves until it does.  The matches of that
    longest length that do not overlap one another are marked (leftmost in the text first, then in the pattern), until
    nothing of ``min_match`` words is left.  Matches are looked up by hash and confirmed word by word; no list of all
    matching places is made, so a round takes n log n steps however often a passage repeats.
    """
    tiles: list[tuple[int, int, int]] = []
    sides = _Side(pattern), _Side(text)
    width = max(min_match, min(len(pattern), len(text)))

    def matches_at(width: int) -> bool:
        (_, p_hash), (_, t_hash) = (side.runs(width) for side in sides)
        return bool(np.isin(t_hash, p_hash).any())

    def longest(limit: int) -> int:
        """The longest length up to ``limit`` that matches, found between a length that does and one that does not."""
        low, high = min_match - 1, limit + 1
        step = min_match
        while step < high and matches_at(step):
            low, step = step, step * 2
        high = min(high, step)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if matches_at(middle) else (low, middle)
        return low

    def mark(width: int) -> bool:
        """Mark what matches at ``width``.  A marked place stays marked: places of equal runs are passed over once in all."""
        (p_at, p_hash), (t_at, t_hash) = (side.runs(width) for side in sides)
        order = np.argsort(p_hash, kind="stable")
        p_at, p_hash = p_at[order], p_hash[order]
        low, high = (np.searchsorted(p_hash, t_hash, end) for end in ("left", "right"))
        found = np.flatnonzero(high > low)
        p_free, t_free = (side.free for side in sides)
        passed: dict[int, int] = {}
        before = len(tiles)
        for t, first, end in zip(t_at[found].tolist(), low[found].tolist(), high[found].tolist()):
            if not (t_free[t] and t_free[t + width - 1]):  # tiles of this round are as long, so one would cover an end
                continue
            at = passed.get(first, first)
            while at < end and not (p_free[p_at[at]] and p_free[p_at[at] + width - 1]):
                at += 1
            passed[first] = at
            for p in p_at[at:end]:
                if p_free[p] and p_free[p + width - 1] and np.array_equal(pattern[p : p + width], text[t : t + width]):
                    p_free[p : p + width] = t_free[t : t + width] = False
                    tiles.append((int(p), t, width))
                    break
        return len(tiles) > before

    while width >= min_match:
        width = longest(width)
        if width >= min_match and not mark(width):
            width -= 1  # equal hashes of different words only
    return tiles


def _items(benchmark: DataFrame) -> DataFrame:
    """item (digest of id and words), item_id, words (hashes) of every different item that has words; no id is -1."""

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = [-1 if i is None else i for i in batch.column(0).to_pylist()]
        blobs = [token_hashes(text.as_py()).tobytes() for text in batch.column(1)]
        held = [(i, blob) for i, blob in zip(ids, blobs) if blob]
        digests = [hashlib.blake2b(i.to_bytes(8, "little", signed=True) + blob, digest_size=16).digest() for i, blob in held]
        yield {"item": digests, "item_id": [i for i, _ in held], "words": [blob for _, blob in held]}

    items = benchmark.select(F.col("item_id").cast("long"), "text")
    return texts.map_batches(items, kernel, "item binary, item_id long, words binary").dropDuplicates(["item"])


def _seeds(items: DataFrame, min_match: int) -> DataFrame:
    """seed, width and item of every distinct run of ``min_match`` words of every item; a shorter item is one seed."""

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        for item, blob in zip(batch.column(0), batch.column(1)):
            hashes = np.frombuffer(blob.as_py(), np.uint64)
            width = min(min_match, len(hashes))
            runs = np.unique(texts.rolled(hashes, width)).view(np.int64)
            yield {"seed": runs, "width": [width] * len(runs), "item": [item.as_py()] * len(runs)}

    return texts.map_batches(items.select("item", "words"), kernel, "seed long, width int, item binary")


class _Seeds:
    """Sorted seeds with a bit table over their leading bits: most runs of a document are dropped by one look into it."""

    def __init__(self, seeds: np.ndarray):
        bits = min(26, max(10, int(64 * len(seeds)).bit_length()))  # at most 64 MB; under 2 % of it is set for up to a million seeds
        self.seeds, self.shift = seeds, np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[seeds >> self.shift] = True

    def among(self, runs: np.ndarray) -> np.ndarray:
        """The sorted distinct ``runs`` that are seeds."""
        maybe = np.unique(runs[self.table[runs >> self.shift]])
        return maybe[self.seeds[np.minimum(np.searchsorted(self.seeds, maybe), len(self.seeds) - 1)] == maybe] if len(maybe) else maybe


def _document_runs(text: str | None, widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    hashes = token_hashes(text)
    return hashes, np.concatenate([texts.rolled(hashes, w) for w in widths] or [np.empty(0, np.uint64)])


def matches(
    documents: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, seed_bytes: int = SEED_BYTES
) -> DataFrame:
    """doc_id, item_id, matched, item_words, coverage of every pair that shares a seed.

    coverage is the share of the item's words under tiles.  Seeds are joined first: a benchmark whose seeds are proven to
    (with the items' words) fit ``seed_bytes`` is looked up inside the tasks that scan the documents; a larger one meets the
    documents' runs in a join on the seed, and words join once the pairs are distinct.  Both give the same pairs.
    """
    items = cut_lineage(_items(benchmark))
    seeds = cut_lineage(_seeds(items, min_match))
    size = seeds.agg(F.count(F.lit(1)).alias("n"), F.collect_set("width").alias("widths")).first()
    item_bytes = items.agg(F.coalesce(F.sum(F.octet_length("words").cast("long") + 64), F.lit(0)).alias("n")).first()["n"]
    widths = sorted(size["widths"])  # at most ``min_match`` values
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, matched int, item_words int, coverage double"
    if size["n"] == 0 or 24 * size["n"] + item_bytes <= seed_bytes:
        held = items.collect()  # with the seeds at most ``seed_bytes``
        number = {bytes(row["item"]): i for i, row in enumerate(held)}
        patterns = [(row["item_id"], np.frombuffer(bytes(row["words"]), np.uint64)) for row in held]
        pairs = sorted((row["seed"] % 2**64, number[bytes(row["item"])]) for row in seeds.select("seed", "item").collect())
        sorted_seeds, owners = np.array([s for s, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64)
        known = _Seeds(sorted_seeds)

        def look_up(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict[str, list] = {name: [] for name in ("doc_id", "item_id", "matched", "item_words", "coverage")}
            for doc, text in zip(batch.column(0), batch.column(1)):
                hashes, runs = _document_runs(text.as_py(), widths)
                runs = known.among(runs)
                ends = (np.searchsorted(sorted_seeds, runs, side) for side in ("left", "right"))
                shared = np.unique(np.concatenate([owners[:0], *(owners[a:b] for a, b in zip(*ends))]))
                for item, pattern in (patterns[i] for i in shared):
                    _append(out, doc.as_py(), item, pattern, hashes, min_match)
            yield out

        return texts.map_batches(rows, look_up, schema)

    def runs_of(batch: pa.RecordBatch) -> Iterator[dict]:
        for doc, text in zip(batch.column(0), batch.column(1)):
            runs = np.unique(_document_runs(text.as_py(), widths)[1]).view(np.int64)
            yield {"doc_id": [doc.as_py()] * len(runs), "seed": runs}

    shared = texts.map_batches(rows, runs_of, "doc_id long, seed long").join(seeds.drop("width"), "seed")
    pairs = shared.select("doc_id", "item").distinct()
    found = pairs.join(items, "item").join(rows, "doc_id").select("doc_id", "item_id", "words", "text")

    def tiled(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {name: [] for name in ("doc_id", "item_id", "matched", "item_words", "coverage")}
        for doc, item, blob, text in zip(*batch.columns):
            _append(out, doc.as_py(), item.as_py(), np.frombuffer(blob.as_py(), np.uint64), token_hashes(text.as_py()), min_match)
        yield out

    return texts.map_batches(found, tiled, schema)


def _append(out: dict[str, list], doc, item: int, pattern: np.ndarray, text: np.ndarray, min_match: int) -> None:
    matched = sum(width for _, _, width in tile(pattern, text, min(min_match, len(pattern))))
    out["doc_id"].append(doc)
    out["item_id"].append(item)
    out["matched"].append(matched)
    out["item_words"].append(len(pattern))
    out["coverage"].append(matched / len(pattern))


def contamination(
    documents: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, min_match: int = MIN_MATCH, seed_bytes: int = SEED_BYTES
) -> DataFrame:
    """Every document with the test item it covers most: doc_id, item_id, coverage, n_items, contaminated.

    contaminated: tiles cover at least ``threshold`` of the words of some item.  item_id is that of the highest coverage,
    the smallest on ties, null without a shared seed (coverage 0).  Null and empty texts, and items without words, share
    nothing; an item without id has item_id -1.  Repeated rows get equal answers; rows sharing a doc_id share theirs;
    rows without doc_id come back uncontaminated with null.  Other columns are ignored.
    """
    found = matches(documents.where(F.col("doc_id").isNotNull()), benchmark, min_match, seed_bytes)
    best = found.groupBy("doc_id").agg(
        F.max(F.struct("coverage", (-F.col("item_id")).alias("i"))).alias("best"), F.countDistinct("item_id").alias("n_items")
    )
    side = small_side(best)
    rows = documents.select(F.col("doc_id").cast("long"))
    joined = rows.join(side, "doc_id", "left")
    coverage = F.coalesce("best.coverage", F.lit(0.0))
    return joined.select(
        "doc_id", (-F.col("best.i")).alias("item_id"), coverage.alias("coverage"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), (coverage >= threshold).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """``documents``, all columns whatever their names, without the contaminated ones.

    Null, empty and unmatched texts stay, rows without doc_id too; rows sharing a doc_id leave together.  An empty table,
    or an empty benchmark, changes nothing.
    """
    found = matches(documents.where(F.col("doc_id").isNotNull()), benchmark)
    name = free_name(documents, "__bad")
    bad = small_side(found.where(F.col("coverage") >= threshold).select(F.col("doc_id").alias(name)).distinct())
    return documents.join(bad, F.col("doc_id") == F.col(name), "left_anti")
