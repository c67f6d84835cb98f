"""Removal of byte strings seen in earlier documents, by hashed anchors in a logarithmic family of sorted levels.

A string of ``LENGTH`` bytes is reached from its anchor, the smallest ``ANCHOR``-byte gram in it: equal strings have equal
anchors at equal places, so only places of anchors (7 % of all) are indexed.  Neighbouring strings with one anchor are a
stretch, and a stretch is one index entry.  Entries are dealt by anchor to tasks.  A task takes its entries in batches of
rising doc_id: each batch is sorted by content hash, looked up in the levels that are already there, and levels of equal
size merge, so n entries lie in log n levels.  No suffix is sorted, and equal hashes count as equal bytes.  Where stretches share an anchor and differ,
their single strings go the same way in a second pass, dealt by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import cut_lineage
from . import texts
from .texts import U64, mix

LENGTH = 50  # bytes of a string that counts as repeated
ANCHOR = 24  # bytes of the gram that strings are found by
BATCH = 65_536  # entries sorted into the family at once
BUCKET_BYTES = 16 * 1024 * 1024  # text whose entries one task holds
KERNEL_BYTES = 16 * 1024 * 1024  # text whose entries a kernel gathers before it deals them out
SLICE = 2**19  # bytes hashed in one go
_PLACE = U64(2**20 - 1)  # low bits of an ordered hash that hold its place in the slice

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, U64), np.full(n, base, U64))))


_POWERS, _INVERSES = _powers(_FACTOR, SLICE + 1), _powers(_INVERSE, SLICE + 1)


class Family:
    """Sorted levels of (key, smallest doc_id), at most one of each size class."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def earliest(self, keys: np.ndarray) -> np.ndarray:
        """Smallest doc_id of every key over all levels; the largest number where there is none."""
        result = np.full(len(keys), np.iinfo(np.int64).max)
        for level, docs in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            found = level[at] == keys
            result[found] = np.minimum(result[found], docs[at[found]])
        return result

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        """Add sorted distinct keys as a level; merge while the last level is not smaller than half the one before."""
        if len(keys):
            self.levels.append((keys, docs))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            (a, da), (b, db) = self.levels.pop(), self.levels.pop()
            both, docs = np.concatenate((a, b)), np.concatenate((da, db))
            order = np.lexsort((docs, both))
            both, docs = both[order], docs[order]
            first = np.concatenate(([True], both[1:] != both[:-1]))
            self.levels.append((both[first], docs[first]))


def scan(keys: np.ndarray, docs: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """Smallest doc_id that has the key, for every entry; entries are taken in batches of rising doc_id."""
    family, result = Family(), np.empty(len(keys), np.int64)
    by_doc = np.argsort(docs, kind="stable")
    for at in range(0, len(keys), batch):
        entries = by_doc[at : at + batch]
        order = entries[np.argsort(keys[entries], kind="stable")]
        sorted_keys = keys[order]
        first = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
        distinct, lowest = sorted_keys[first], docs[order][first]
        earlier = family.earliest(distinct)
        new = earlier == np.iinfo(np.int64).max
        result[order] = np.minimum(lowest, earlier)[np.cumsum(first) - 1]
        family.add(distinct[new], lowest[new])
    return result


class _Slice:
    """Segments of documents side by side, with prefix sums that give the hash of any byte range."""

    def __init__(self, segments: list[tuple[int, int, bytes]]):
        self.index = np.array([i for i, _, _ in segments])
        self.base = np.array([b for _, b, _ in segments])
        sizes = np.array([len(s) for _, _, s in segments])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.data = np.frombuffer(b"".join(s for _, _, s in segments), np.uint8)
        n = len(self.data)
        self.sums = np.concatenate((np.zeros(1, U64), np.cumsum((self.data.astype(U64) + U64(1)) * _POWERS[:n])))

    def hashes(self, start: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        value = (self.sums[start + width] - self.sums[start]) * _INVERSES[start]
        return mix(value + np.asarray(width, U64) * U64(0xD1B54A32D192ED03))

    def stretches(self):
        """(document index, start in it, strings, anchor hash, content hash) of every stretch of strings with one anchor."""
        n = len(self.data)
        grams = np.arange(n - ANCHOR + 1)
        hashed = self.hashes(grams, ANCHOR)
        ordered = (hashed & ~_PLACE) | grams.astype(U64)
        low, width, reach = ordered, 1, LENGTH - ANCHOR + 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
        owner = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)
        strings = np.flatnonzero(np.arange(len(low)) + LENGTH <= self.ends[owner[: len(low)]])
        if len(strings) == 0:
            return None
        anchor = (low[strings] & _PLACE).astype(np.int64)
        first = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (strings[1:] != strings[:-1] + 1)))
        start, anchor = strings[first], anchor[first]
        count = np.diff(np.append(np.flatnonzero(first), len(strings)))
        content = mix(self.hashes(start, count + (LENGTH - 1)) + (anchor - start).astype(U64))
        segment = owner[start]
        return self.index[segment], start - self.starts[segment] + self.base[segment], count, hashed[anchor], content


def _slices(documents: list[bytes]) -> Iterator[_Slice]:
    """Documents in slices of ``SLICE`` bytes; a longer one in segments that overlap so that no string is lost."""
    held, size = [], 0
    for i, data in enumerate(documents):
        for base in range(0, max(1, len(data) - LENGTH + 1), SLICE - LENGTH + 1):
            segment = data[base : base + SLICE]
            if len(segment) < LENGTH:
                continue
            if size + len(segment) > SLICE:
                yield _Slice(held)
                held, size = [], 0
            held.append((i, base, segment))
            size += len(segment)
    if held:
        yield _Slice(held)


_COLUMNS = (("key", "<u8"), ("tag", "<u4"), ("start", "<u4"), ("count", "u1"))


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Places where a run of equal rows begins."""
    change = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1)) if len(columns[0]) else np.empty(0, np.int64)


def _packed(columns: dict[str, np.ndarray], pick: np.ndarray) -> bytes:
    """Some entries as one compressed blob: every document once with its number of entries, then a column after the other."""
    doc, row = columns["doc"][pick], columns["row"][pick]
    heads = _heads(doc, row)
    parts = [doc[heads].astype("<i8"), row[heads].astype("<i8"), np.diff(np.append(heads, len(pick))).astype("<u4")]
    for name, kind in _COLUMNS:
        values = columns[name][pick].astype(kind)
        parts.append(np.diff(values, prepend=values.dtype.type(0)) if name == "start" else values)
    raw = b"".join(p.tobytes() for p in parts)
    return len(pick).to_bytes(8, "little") + len(heads).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    sides = []
    width = sum(np.dtype(t).itemsize for _, t in _COLUMNS)
    for blob in blobs:
        n, heads = (int.from_bytes(blob[i : i + 8], "little") for i in (0, 8))
        raw, at = pa.decompress(blob[16:], n * width + heads * 20, "zstd", asbytes=True), heads * 20
        times = np.frombuffer(raw, "<u4", heads, heads * 16)
        side = {name: np.repeat(np.frombuffer(raw, "<i8", heads, i * heads * 8), times) for i, name in enumerate(("doc", "row"))}
        for name, kind in _COLUMNS:
            side[name] = np.frombuffer(raw, kind, n, at)
            at += n * np.dtype(kind).itemsize
        side["start"] = np.cumsum(side["start"], dtype=np.uint32)
        sides.append(side)
    return {name: np.concatenate([s[name] for s in sides]) for name in ("doc", "row", *(n for n, _ in _COLUMNS))}


def _dealt(columns: dict[str, np.ndarray], route: np.ndarray, buckets: int) -> Iterator[dict]:
    """Blobs by bucket.  An entry whose key the batch has in a smaller doc_id is known to be repeated: it goes, without its
    key, to a negative bucket that its document names and is not looked up again.  So a key sends one document's entries per
    batch however often it occurs, and no bucket grows with the number of documents that share a passage."""
    if len(columns["key"]) == 0:
        return
    order = np.lexsort((columns["doc"], columns["key"]))
    heads = _heads(columns["key"][order])
    lowest = np.repeat(columns["doc"][order][heads], np.diff(np.append(heads, len(order))))
    known = np.zeros(len(order), bool)
    known[order] = columns["doc"][order] > lowest
    by_document = (mix(columns["doc"].astype(U64)) % U64(buckets)).astype(np.int64)
    bucket = np.where(known, -1 - by_document, (route % U64(buckets)).astype(np.int64))
    columns = columns | {name: np.where(known, 0, columns[name]).astype(columns[name].dtype) for name in ("key", "tag")}
    by_bucket = np.argsort(bucket, kind="stable")
    edges = np.append(_heads(bucket[by_bucket]), len(by_bucket))
    for a, b in zip(edges[:-1], edges[1:]):
        yield {"bucket": [bucket[by_bucket[a]]], "entries": [_packed(columns, by_bucket[a:b])]}


_FOUND = "doc long, row long, stretch long, risky boolean"  # a stretch as 256 * start + number of strings


def _scanned(dealt: DataFrame, look_for_risk: bool) -> DataFrame:
    """Entries that an earlier document has, and those (``risky``) whose single strings must be looked at."""
    schema, arrow = texts.schemas(_FOUND)

    def bucket_task(key, table):
        columns = _unpacked(table.column("entries").to_pylist())
        risky = np.empty(0, np.int64)
        if key[0].as_py() < 0:
            found = np.arange(len(columns["key"]))
        else:
            repeated = columns["doc"] > scan(columns["key"], columns["doc"])
            found = np.flatnonzero(repeated)
            if look_for_risk:
                # first holders of stretches whose anchor also has other stretches
                order = np.lexsort((columns["key"], columns["tag"]))
                tags, keys = columns["tag"][order], columns["key"][order]
                at = _heads(tags)
                mixed = np.minimum.reduceat(keys, at) != np.maximum.reduceat(keys, at)
                shared = np.zeros(len(keys), bool)
                shared[order] = np.repeat(mixed, np.diff(np.append(at, len(keys))))
                risky = np.flatnonzero(shared & ~repeated)
        pick = np.concatenate((found, risky))
        stretch = columns["start"][pick].astype(np.int64) * 256 + columns["count"][pick]
        values = columns["doc"][pick], columns["row"][pick], stretch, np.arange(len(pick)) >= len(found)
        return pa.table([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    return dealt.groupBy("bucket").applyInArrow(bucket_task, schema)


def _stretches(documents: DataFrame, buckets: int) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        sizes = np.cumsum(pc.binary_length(batch.column(2).cast(pa.large_string())).to_numpy(zero_copy_only=False))
        cuts = np.searchsorted(sizes, np.arange(KERNEL_BYTES, sizes[-1] + KERNEL_BYTES, KERNEL_BYTES)) + 1 if len(sizes) else []
        at = 0
        for end in cuts:
            if end > at:
                yield from of_documents(batch.slice(at, end - at))
            at = max(at, end)

    def of_documents(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        parts = []
        for piece in _slices([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]):
            if (found := piece.stretches()) is not None:
                parts.append(found)
        if not parts:
            return
        index, start, count, anchor, content = (np.concatenate(c) for c in zip(*parts))
        columns = {
            "key": content, "tag": (anchor >> U64(32)).astype(np.uint32), "doc": ids[index], "row": rows[index],
            "start": start, "count": count,
        }
        yield from _dealt(columns, anchor, buckets)

    return texts.map_batches(documents, kernel, "bucket long, entries binary")


def _single_strings(risky: DataFrame, buckets: int) -> DataFrame:
    """Every string of the risky stretches as an entry of its own.  ``risky``: doc, row, text and its risky stretches."""

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        parts = []
        for i, (text, stretches) in enumerate(zip(batch.column(2), batch.column(3))):
            data = text.as_py().encode("utf-8", "surrogatepass")
            packed = stretches.values.to_numpy()
            wanted = np.zeros(len(data) + 1, np.int64)
            np.add.at(wanted, packed >> 8, 1)
            np.add.at(wanted, (packed >> 8) + (packed & 255), -1)
            strings = np.flatnonzero(np.cumsum(wanted) > 0)
            for base in range(0, max(1, len(data) - LENGTH + 1), SLICE - LENGTH + 1):
                inside = strings[(strings >= base) & (strings < base + SLICE - LENGTH + 1)]
                if len(inside):
                    piece = _Slice([(i, base, data[base : base + SLICE])])
                    parts.append((np.full(len(inside), i), inside, piece.hashes(inside - base, LENGTH)))
        if not parts:
            return
        index, start, key = (np.concatenate(c) for c in zip(*parts))
        columns = {
            "key": key, "tag": np.zeros(len(key), np.uint32), "doc": ids[index], "row": rows[index], "start": start,
            "count": np.ones(len(key), np.uint8),
        }
        yield from _dealt(columns, key, buckets)

    return texts.map_batches(risky, kernel, "bucket long, entries binary")


def _by_document(found: DataFrame) -> DataFrame:
    """Stretches of every document in one row; their number is bounded by the document's length."""
    lists = {"found": ~F.col("risky"), "risky": F.col("risky")}
    return found.groupBy("doc", "row").agg(*[F.collect_list(F.when(c, F.col("stretch"))).alias(n) for n, c in lists.items()])


def covered_spans(stretches: np.ndarray) -> list[list[int]]:
    """Maximal byte runs [start, end) that the strings of some stretches (256 * start + number of strings) cover."""
    if len(stretches) == 0:
        return []
    ordered = np.sort(stretches)
    start = ordered >> 8
    reached = np.maximum.accumulate(start + (ordered & 255) - 1 + LENGTH)
    first = np.concatenate(([True], start[1:] > reached[:-1]))
    last = np.append(np.flatnonzero(first)[1:] - 1, len(start) - 1)
    return np.stack((start[first], reached[last]), axis=1).tolist()


def repeated_stretches(keyed: DataFrame) -> DataFrame:
    """doc, row (hash of the text) and stretches of strings that also start in a document with a smaller doc_id.

    ``keyed``: doc, row, text, without nulls.  What the first pass finds is stored by document.
    """
    size = keyed.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()["bytes"] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    first = cut_lineage(_by_document(_scanned(_stretches(keyed, buckets), look_for_risk=True)))
    risky = first.where(F.size("risky") > 0).select("doc", "row", "risky")
    placed = keyed.repartition("doc", "row").join(risky, ["doc", "row"]).select("doc", "row", "text", "risky")
    single = _by_document(_scanned(_single_strings(placed, buckets), look_for_risk=False)).select("doc", "row", "found")
    both = first.select("doc", "row", "found").unionByName(single)
    return both.groupBy("doc", "row").agg(F.flatten(F.collect_list("found")).alias("found"))


def remove_repeats(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """Every document without the bytes that earlier documents have: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a 50-byte string covers it that also starts in a document with a smaller doc_id, judged on the texts as
    given.  Null text is empty; texts under 50 bytes lose nothing.  Rows without doc_id lose nothing and are nobody's
    earlier document.  Rows that share a doc_id do not count as earlier for each other; equal rows get equal answers.
    ``with_text`` adds spans and the bytes that stay.  Other columns are ignored; an empty table gives an empty result.
    Texts are dealt by document once: single strings and answers read the same exchange.
    """
    every = documents.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row"), "text")
    usable = F.coalesce(F.col("doc").isNotNull() & (F.octet_length("text") >= LENGTH), F.lit(False))
    keyed = every.where(F.col("doc").isNotNull() & (F.octet_length("text") >= LENGTH))
    answered = keyed.repartition("doc", "row").join(repeated_stretches(keyed), ["doc", "row"], "left").select("doc", "text", "found")
    joined = answered.unionByName(every.where(~usable).select("doc", "text", F.lit(None).cast("array<long>").alias("found")))

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * with_text
        out: dict[str, list] = {name: [] for name in names}
        for doc, text, found in zip(*batch.columns):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            spans = covered_spans(found.values.to_numpy()) if found.is_valid else []
            edges = [0, *(x for span in spans for x in span), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            values = [doc.as_py(), len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans]
            for name, value in zip(names, values):
                out[name].append(value)
        yield out

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return texts.map_batches(joined, kernel, schema + (", kept binary, spans array<array<long>>" if with_text else ""))
