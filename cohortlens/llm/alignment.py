"""Tokens of two tokenizers over the same texts, aligned by their bytes, and how often their ids are linked corpus-wide.

Texts are cut where neither tokenizer can join (a single space or line feed between other characters).  A task takes some
megabytes of text at once and aligns all their distinct pieces in one go: intervals of all tokens of both tokenizers are
sorted by start, a group ends where the next start reaches the running maximum of the ends, and the overlaps inside groups
are expanded to links.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import cut_lineage
from . import texts

RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")  # both must be readable on every executor
MODEL_PATH = public_tokenizers.path("piece_bpe_32k.model")
SLICE_BYTES = 4 * 1024 * 1024  # text aligned in one go
ENCODED = 50_000  # pieces the model is given at once
HELD_PAIRS = 1_000_000  # id pairs a task counts before it passes them on
HEAD_PAIRS = 1_000_000  # most frequent id pairs sent to all tasks; the others are looked up by a join

_ODD = r"[ \n][ \n]|^ ?$|[ \n]$|[\x00\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CUT = re.compile(r"(?<=\S) (?=\S)")  # \S is narrower here than for either tokenizer, so a cut is always safe
_SHAPE = r"[\x00\t\n\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|. |^ ?$"  # pieces that are no words


def coalesce(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of every A and of every B token, and the token numbers (a, b) of all overlapping pairs.

    Both sides cut the same bytes into tokens that end at ``ends_a`` and ``ends_b``.
    """
    starts_a, starts_b = (np.concatenate(([0], e[:-1])) if len(e) else e for e in (ends_a, ends_b))
    starts, ends = np.concatenate((starts_a, starts_b)), np.concatenate((ends_a, ends_b))
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.concatenate(([0], np.cumsum(starts[order][1:] >= reached[:-1]))) if len(order) else 0
    low, high = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
    width = high - low
    a = np.repeat(np.arange(len(ends_a)), width)
    b = np.arange(len(a)) + np.repeat(low - (np.cumsum(width) - width), width)
    return group[: len(ends_a)], group[len(ends_a) :], a, b


def _wide(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _gather(blob: np.ndarray, widths: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Runs of ``blob`` (run k is ``widths[k]`` long) in the order of ``index``."""
    width = widths[index]
    ends = np.cumsum(width)
    return blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(widths) - widths)[index] - (ends - width), width)]


class Slice:
    """Texts cut into pieces: what is known of the distinct pieces, their numbers in text order, pieces per text (none if invalid).

    ``runs`` holds, for each of ``A_IDS`` to ``KEYS``, the values of all distinct pieces one after the other, and how many
    each piece has.
    """

    def __init__(self, runs: list[tuple[np.ndarray, np.ndarray]], index: np.ndarray, counts: np.ndarray):
        self.runs, self.index, self.counts = runs, index, counts

    def per_text(self, per_piece: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(per_piece[self.index])))
        ends = np.cumsum(self.counts)
        return total[ends] - total[ends - self.counts]

    def offsets(self, per_piece: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.per_text(per_piece)))).astype(np.int32)

    def lists(self, field: int) -> pa.ListArray:
        """The ids of every text."""
        values, widths = self.runs[field]
        return pa.ListArray.from_arrays(pa.array(self.offsets(widths)), pa.array(_gather(values, widths, self.index).astype(np.int32)))

    def ends(self, field: int, tokens: int) -> pa.ListArray:
        """Where groups end, in tokens of the text."""
        values, widths = self.runs[field]
        n = self.runs[tokens][1]
        before, own = np.cumsum(n[self.index]) - n[self.index], self.per_text(n)
        text = np.repeat(np.cumsum(own) - own, self.counts)
        values = _gather(values, widths, self.index) + np.repeat(before - text, widths[self.index])
        return pa.ListArray.from_arrays(pa.array(self.offsets(widths)), pa.array(values.astype(np.int32)))


A_IDS, B_IDS, A_ENDS, B_ENDS, KEYS = range(5)  # what is known of a piece


class Aligner:
    def __init__(self, ranks_path: str = RANKS_PATH, model_path: str = MODEL_PATH):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self._bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._bytes_a[rank] = token
        self.size_b = self._b.get_piece_size()
        names = self._b.id_to_piece(list(range(self.size_b)))
        self._bytes_b = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)
        ]
        self._lengths = [np.array(list(map(len, table)), np.int64) for table in (self._bytes_a, self._bytes_b)]
        self._line_feed = self._a.encode_single_token("\n")
        self._lead = self._b.encode("\n")  # the model begins with a space of its own; a line feed keeps it from the piece

    def slices(self, column: pa.Array) -> Iterator[tuple[int, Slice]]:
        """Texts in order, as many at once as ``SLICE_BYTES`` holds: how many, and their pieces."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False) + 64)
        at = 0
        while at < len(column):
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)))
            yield until - at, self._slice(column.slice(at, until - at))
            at = until

    def _slice(self, column: pa.Array) -> Slice:
        spaced = pc.binary_join_element_wise(_wide(""), column, _wide(" "))
        plain = pc.replace_substring(pc.replace_substring(spaced, " ", "\0 "), "\n", "\0\n\0")
        odd = pc.match_substring_regex(spaced, _ODD).to_pylist()
        if any(odd):
            marked, uncut = plain.to_pylist(), {}
            for row in np.flatnonzero(odd).tolist():
                text = spaced[row].as_py()
                if "\0" in text:
                    uncut[row], marked[row] = text, ""
                else:
                    marked[row] = "" if text == " " else _CUT.sub("\0 ", text)
            plain = pa.array(marked, pa.large_string())
        else:
            uncut = {}
        cut = pc.split_pattern(plain, "\0")
        pieces = cut.flatten().dictionary_encode()
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        index, counts = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds)
        distinct = pieces.dictionary.to_pylist()
        words = pc.invert(pc.match_substring_regex(pieces.dictionary, _SHAPE)).to_pylist()
        for row, text in sorted(uncut.items(), reverse=True):  # such a text has one empty piece so far
            index[bounds[row]] = len(distinct)
            distinct.append(text)
            words.append(False)
        valid, runs = self._align(distinct, np.array(words, bool))
        bad = np.concatenate(([0], np.cumsum(~valid[index])))
        sound = bad[bounds[1:]] == bad[bounds[:-1]]
        return Slice(runs, index[np.repeat(sound, counts)], np.where(sound, counts, 0))

    def _ids_a(self, pieces: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has: one call over all words, a line each, one for every piece of another shape."""
        at = np.flatnonzero(words)
        ids = self._a.encode_to_numpy("\n".join([pieces[k] for k in at]), disallowed_special=()).astype(np.int64)
        feeds = ids == self._line_feed
        n = np.zeros(len(pieces), np.int64)
        n[at] = np.diff(np.flatnonzero(np.concatenate(([True], feeds, [True])))) - 1 if len(at) else 0
        others = {int(k): self._a.encode_ordinary(pieces[k]) for k in np.flatnonzero(~words)}
        n[list(others)] = list(map(len, others.values()))
        result = np.empty(int(n.sum()), np.int64)
        result[np.repeat(words, n)] = ids[~feeds]
        result[np.repeat(~words, n)] = np.fromiter(chain.from_iterable(others.values()), np.int64)
        return result, n

    def _ids_b(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_ids_a`` by the model; ids of the lead before each piece are taken off."""
        parts, widths, lead = [], [], len(self._lead)
        for at in range(0, len(pieces), ENCODED):
            ids = self._b.encode(["\n" + p for p in pieces[at : at + ENCODED]], num_threads=1)
            widths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            parts.append(np.fromiter(chain.from_iterable(ids), np.int64, int(widths[-1].sum())))
        flat, n = np.concatenate([np.empty(0, np.int64), *parts]), np.concatenate([np.empty(0, np.int64), *widths])
        keep, first = np.ones(len(flat), bool), np.cumsum(n) - n
        for k, token in enumerate(self._lead):
            if (flat[first + k] != token).any():
                raise ValueError("the model joins a line feed with what follows")
            keep[first + k] = False
        return flat[keep], n - lead

    def _align(self, pieces: list[str], words: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which pieces both tokenizers give back byte by byte, and ids, group ends and links of all pieces."""
        (a, n_a), (b, n_b) = self._ids_a(pieces, words), self._ids_b(pieces)
        raw = list(map(str.encode, pieces))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        valid = np.ones(len(pieces), bool)
        for ids, n, table, lengths in ((a, n_a, self._bytes_a, self._lengths[0]), (b, n_b, self._bytes_b, self._lengths[1])):
            piece = np.repeat(np.arange(len(pieces)), n)
            valid &= np.bincount(piece, lengths[ids], len(pieces)).astype(np.int64) == sizes
            if b"".join(map(table.__getitem__, ids.tolist())) != b"".join(raw):  # only then piece by piece
                cuts = np.concatenate(([0], np.cumsum(n))).tolist()
                listed = ids.tolist()
                valid &= [b"".join(map(table.__getitem__, listed[x:y])) == r for x, y, r in zip(cuts[:-1], cuts[1:], raw)]
        if not valid.all():
            a, b = a[np.repeat(valid, n_a)], b[np.repeat(valid, n_b)]
            n_a, n_b = np.where(valid, n_a, 0), np.where(valid, n_b, 0)
        group_a, group_b, left, right = coalesce(np.cumsum(self._lengths[0][a]), np.cumsum(self._lengths[1][b]))
        first = np.flatnonzero(np.diff(group_a, prepend=-1))
        piece = np.repeat(np.arange(len(pieces)), n_a)
        n_groups, n_links = np.bincount(piece[first], minlength=len(pieces)), np.bincount(piece[left], minlength=len(pieces))
        total = int(n_groups.sum())
        ends = [np.cumsum(np.bincount(g, minlength=total)) - np.repeat(np.cumsum(n) - n, n_groups) for g, n in ((group_a, n_a), (group_b, n_b))]
        return valid, [(a, n_a), (b, n_b), (ends[0], n_groups), (ends[1], n_groups), (a[left] * self.size_b + b[right], n_links)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(ranks_path: str = RANKS_PATH, model_path: str = MODEL_PATH) -> Aligner:
    """The aligner of this process."""
    if (ranks_path, model_path) not in _aligners:
        _aligners[ranks_path, model_path] = Aligner(ranks_path, model_path)
    return _aligners[ranks_path, model_path]


def pair_counts(documents: DataFrame, ranks_path: str = RANKS_PATH, model_path: str = MODEL_PATH) -> DataFrame:
    """key, a_id, b_id, n (links of the corpus that hold the two ids), best (no A id is linked with this B id more often).

    Tasks count the pieces of their texts, turn them into id pairs, and pass on at most ``HELD_PAIRS`` of them at a time.
    """
    schema, arrow = texts.schemas("key long, n long")
    texts.bound_batches(documents)

    def run(batches):
        keys, counts, held = [], [], 0

        def merged():
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, place, np.concatenate(counts))
            return distinct, total

        for batch in batches:
            for _, part in aligner(ranks_path, model_path).slices(batch.column(0)):
                links, widths = part.runs[KEYS]
                keys.append(links)
                counts.append(np.repeat(np.bincount(part.index, minlength=len(widths)), widths))
                held += len(links)
                if held > HELD_PAIRS:
                    distinct, total = merged()
                    keys, counts, held = [distinct], [total], len(distinct)
                    if held > HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(total)], schema=arrow)
                        keys, counts, held = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], schema=arrow)

    size_b = sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()
    found = documents.select(F.col("text").cast("string")).mapInArrow(run, schema).where("n > 0")
    totals = cut_lineage(found.groupBy("key").agg(F.sum("n").alias("n")).withColumn("b_id", F.pmod("key", F.lit(size_b))))
    most = totals.groupBy("b_id").agg(F.max("n").alias("most"))
    a_id = F.floor((F.col("key") - F.col("b_id")) / size_b).cast("long").alias("a_id")
    return cut_lineage(totals.join(most, "b_id").select("key", a_id, "b_id", "n", (F.col("n") == F.col("most")).alias("best")))


def _head(pairs: DataFrame, limit: int) -> tuple[dict[str, np.ndarray], bool]:
    """The most frequent pairs as arrays sorted by key, and whether there are others."""
    rest = pairs.count() > limit
    head = (pairs.orderBy(F.col("n").desc(), "key").limit(limit) if rest else pairs).select("key", "n", "best").toArrow().sort_by("key")
    return {c: head.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "best")}, rest


def grouped(documents: DataFrame, pairs: DataFrame, head_pairs: int = HEAD_PAIRS, ranks_path: str = RANKS_PATH, model_path: str = MODEL_PATH) -> DataFrame:
    """Tokens and groups of every text, and what the most frequent pairs add to its sums.

    doc_id, a_ids, b_ids, a_ends, b_ends (group k is a_ids[a_ends[k-1]:a_ends[k]] beside the like of b), n_links, n_best,
    count_sum, tail (keys of the links whose pair is not among the ``head_pairs`` most frequent; null if there are none).
    """
    head, rest = _head(pairs, head_pairs)
    sent = documents.sparkSession.sparkContext.broadcast(head)

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        at = 0
        for rows, part in aligner(ranks_path, model_path).slices(batch.column(1)):
            keys, widths = part.runs[KEYS]
            place = np.minimum(np.searchsorted(sent.value["key"], keys), max(len(sent.value["key"]) - 1, 0))
            known = sent.value["key"][place] == keys if len(sent.value["key"]) else np.zeros(len(keys), bool)
            piece = np.repeat(np.arange(len(widths)), widths)
            add = lambda values: _sums(piece[known], values[place[known]], len(widths))
            tail = [None] * rows
            if rest:
                unknown = np.bincount(piece[~known], minlength=len(widths))
                offsets, values = part.offsets(unknown), _gather(keys[~known], unknown, part.index)
                tail = [values[x:y].tolist() or None for x, y in zip(offsets[:-1], offsets[1:])]
            yield {
                "doc_id": batch.column(0).slice(at, rows), "a_ids": part.lists(A_IDS), "b_ids": part.lists(B_IDS),
                "a_ends": part.ends(A_ENDS, A_IDS), "b_ends": part.ends(B_ENDS, B_IDS), "n_links": part.per_text(widths),
                "n_best": part.per_text(add(sent.value["best"])), "count_sum": part.per_text(add(sent.value["n"])), "tail": tail,
            }
            at += rows

    schema = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, n_links long, n_best long, count_sum long, tail array<long>"
    return texts.map_batches(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), kernel, schema)


def _sums(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n, np.int64)
    np.add.at(total, place, values.astype(np.int64))
    return total


def with_tail(rows: DataFrame, pairs: DataFrame, rest: bool) -> DataFrame:
    """``rows`` with the sums of the rarer pairs added and the column tail left out.

    Without rarer pairs nothing moves.  Otherwise each row's distinct rare pairs meet their counts in a join by pair: a
    pair that most rows hold is not rare, so no key is hot.
    """
    if not rest:
        return rows.drop("tail")
    stored = cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()))
    keys = stored.where("tail is not null").select("__row", F.explode("tail").alias("key"))
    found = keys.groupBy("__row", "key").agg(F.count(F.lit(1)).alias("c")).join(pairs.select("key", "n", "best"), "key")
    sums = found.groupBy("__row").agg(F.sum(F.col("c") * F.col("n")).alias("__sum"), F.sum(F.col("c") * F.col("best").cast("long")).alias("__best"))
    more = lambda name, extra: F.col(name) + F.coalesce(F.col(extra), F.lit(0))
    joined = stored.join(sums, "__row", "left").withColumns({"n_best": more("n_best", "__best"), "count_sum": more("count_sum", "__sum")})
    return joined.drop("__row", "__sum", "__best", "tail")


def align(documents: DataFrame, head_pairs: int = HEAD_PAIRS, ranks_path: str = RANKS_PATH, model_path: str = MODEL_PATH) -> DataFrame:
    """Every document's tokens of both tokenizers in groups, with its links: the columns of ``grouped`` but for tail.

    A is the byte-level BPE over a space and the text, B the piece model over the text (it adds the space); strings of
    control tokens are plain text.  A group ends at each byte where a token of A and one of B both end.  A link is a pair of
    an A and a B token whose bytes overlap; a pair of ids counts as often as the corpus links them.  count_sum adds up the
    counts of a document's links, n_best counts the links whose count is the highest of their B id, ties included.

    Null and empty texts, and texts whose joined tokens differ from space and text, have no tokens: empty lists and zeros.
    Rows that repeat count, and come back, as often as they are given; so do rows without doc_id.  Other columns are
    ignored; an empty table gives an empty result.
    """
    pairs = pair_counts(documents, ranks_path, model_path)
    return with_tail(grouped(documents, pairs, head_pairs, ranks_path, model_path), pairs, pairs.count() > head_pairs)


def _group_texts(batch: pa.RecordBatch) -> list[bytes]:
    """``a1,a2|b1;a3|b2`` of every row, from ids and group ends."""
    sides = []
    for ids, ends in (("a_ids", "a_ends"), ("b_ids", "b_ends")):
        ids, ends = batch.column(ids), batch.column(ends)
        bounds = ends.offsets.to_numpy().astype(np.int64)
        first = np.repeat(ids.offsets.to_numpy()[:-1].astype(np.int64) - ids.offsets[0].as_py(), np.diff(bounds))
        sides.append((ids.flatten(), ends.flatten().to_numpy().astype(np.int64) + first, np.diff(bounds)))
    (a, ends_a, groups), (b, ends_b, _) = sides
    ids = pa.concat_arrays([a, b])
    group = np.concatenate([np.searchsorted(e, np.arange(len(x)), "right") for x, e in ((a, ends_a), (b, ends_b))])
    order = np.argsort(group * 2 + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
    mark = np.full(len(ids), 0)  # what follows a token: , inside a side, | after A, ; after B
    mark[ends_a - 1], mark[len(a) + ends_b - 1] = 1, 2
    marks = pa.DictionaryArray.from_arrays(pa.array(mark[order].astype(np.int8)), pa.array([",", "|", ";"])).cast(pa.large_string())
    joined = pc.binary_join_element_wise(ids.take(pa.array(order)).cast(pa.large_string()), marks, _wide(""))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = memoryview(joined.buffers()[2]) if len(joined) else b""
    tokens = np.zeros(len(groups) + 1, np.int64)
    for side in ("a_ids", "b_ids"):
        tokens += batch.column(side).offsets.to_numpy() - batch.column(side).offsets[0].as_py()
    return [data[offsets[x] : offsets[y] - 1] if y > x else b"" for x, y in zip(tokens[:-1].tolist(), tokens[1:].tolist())]


def digest(rows: DataFrame) -> DataFrame:
    """Sizes and a digest in place of ids and groups: doc_id, n_a, n_b, n_groups, groups_sha256, and the other columns."""
    sizes = {"n_a": "a_ids", "n_b": "b_ids", "n_groups": "a_ends"}
    rest = [f.name for f in rows.schema if f.name not in ("a_ids", "b_ids", "a_ends", "b_ends", "doc_id")]

    def kernel(batch: pa.RecordBatch) -> Iterator[dict]:
        ends = np.cumsum(pc.list_value_length(batch.column("a_ids")).to_numpy())
        at = 0
        while at < batch.num_rows:  # some hundred thousand tokens at once
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 400_000)))
            part = batch.slice(at, until - at)
            named = [hashlib.sha256(t).hexdigest() if len(t) else "" for t in _group_texts(part)]
            columns = {n: pc.list_value_length(part.column(c)) for n, c in sizes.items()}
            yield {"doc_id": part.column("doc_id"), "groups_sha256": named} | columns | {c: part.column(c) for c in rest}
            at = until

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return texts.map_batches(rows, kernel, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string" + (f", {kept}" if kept else ""))
