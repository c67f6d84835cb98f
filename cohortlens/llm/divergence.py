"""How far sources of a language differ in their terms, by a frequent-pattern tree over term rows.

A term's row lists, in source order, the sources that hold it with their counts.  Rows that begin alike share a path of the
tree, so what two sources' counts add to their distance is worked out once per node and ancestor, times the rows below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scale import cut_lineage, first_rows, small_side
from . import texts

MIN_DOCUMENTS = 30  # documents of a language that hold a kept term
SMOOTHING = 5  # added to every count
SCALE = 1_000_000_000  # shares are whole numbers of this
TOP = 50  # ranks of the term report
HELD_TERMS = 300_000  # (language, source, term) counts a task holds before it passes them on
SLICE_BYTES = 8 * 1024 * 1024  # text split in one go
HELD_CELLS = 4_000_000  # pair sums a task holds before it passes them on

# bytes of a term stay (A-Z lower-cased), all others end it: bytes from 0x80 on belong to characters of terms
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in parts that end between terms."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        end = text.find(b" ", at + SLICE_BYTES)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it); term null once per group, even one without terms.

    Tasks count their own rows first and pass on at most ``HELD_TERMS`` counts at a time.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    texts.bound_batches(documents)
    schema, arrow = texts.schemas("lang string, source string, term string, n long, docs long")

    def emit(held):
        for (lang, source), found in held.items():
            terms = [None, *(t.decode("utf-8", "replace") for t in found)]
            counts = np.array([(0, 0), *found.values()], np.int64)
            columns = [[lang] * len(terms), [source] * len(terms), terms, counts[:, 0], counts[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
        held.clear()

    def run(batches):
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                group = held.setdefault((lang.as_py(), source.as_py()), {})
                before, last = len(group), {}
                for part in _slices(text.as_buffer().to_pybytes().translate(_BYTES)):
                    for term in part.split():
                        last[term] = last.get(term, 0) + 1
                for term, n in last.items():
                    entry = group.get(term)
                    if entry is None:
                        group[term] = [n, 1]
                    else:
                        entry[0] += n
                        entry[1] += 1
                size += len(group) - before
                if size > HELD_TERMS:
                    yield from emit(held)
                    size = 0
        yield from emit(held)

    counted = documents.select(*text).mapInArrow(run, schema)
    return counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * kept)), exact; null where there is nothing to divide by."""
    whole = (n + SMOOTHING).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + F.lit(SMOOTHING).cast("long") * kept).cast("decimal(19,0)")
    return F.call_function("div", whole, F.nullif(below, F.lit(0).cast("decimal(19,0)"))) + 1


def pair_corrections(paths: DataFrame) -> DataFrame:
    """lang, i, j (places of two sources, i < j), correction: sums over ``paths`` (lang, path, rows).

    Paths are dealt by range, so paths that begin alike meet in one task; a task walks its sorted paths as the tree they
    form.  When a node is left, its rows are known, and each of its ancestors gets the pair's correction times these rows:
    what both counts together change beside what each changes alone.  Sums are whole numbers, so trees cut at a range's
    edge add up to the same.
    """
    schema, arrow = texts.schemas("lang string, i int, j int, correction long")
    ranged = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")

    def emit(sums):
        for (lang, j), row in sums.items():
            at = np.flatnonzero(row)
            if len(at):
                columns = [[lang] * len(at), at, np.full(len(at), j), row[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
        sums.clear()

    def run(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        nodes: list[tuple[int, int, int]] = []  # open nodes from the root on: place, share, zero share
        rows: list[int] = []  # rows seen below each open node
        place, own, zero = (np.empty(64, np.int64) for _ in range(3))
        tree, cells = None, 0

        def leave(depth):
            """Close nodes beyond ``depth``; their rows count for their parents too."""
            nonlocal cells
            while len(nodes) > depth:
                (j, p, p0), n, d = nodes.pop(), rows.pop(), len(nodes)
                if d == 0:
                    continue
                rows[-1] += n
                q, q0 = own[:d], zero[:d]
                both = np.abs(p - q) - np.abs(p - q0) - np.abs(p0 - q) + np.abs(p0 - q0)
                row = sums.get((tree, j))
                if row is None:
                    row = sums[tree, j] = np.zeros(j, np.int64)
                    cells += j
                row[place[:d]] += n * both

        for batch in batches:
            path = batch.column(1)
            bounds, items = path.offsets.to_pylist(), path.values
            steps = list(zip(*(items.field(k).to_pylist() for k in range(3))))
            first = bounds[0]
            if len(steps) != bounds[-1] - first:  # the values of a sliced array are not sliced
                steps, first = steps[bounds[0] : bounds[-1]], bounds[0]
            for k, (lang, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if lang != tree:
                    leave(0)
                    tree = lang
                    if cells > HELD_CELLS:
                        yield from emit(sums)
                        cells = 0
                row = steps[bounds[k] - first : bounds[k + 1] - first]
                shared = 0
                while shared < min(len(row), len(nodes)) and row[shared] == nodes[shared]:
                    shared += 1
                leave(shared)
                if len(row) > len(place):
                    place, own, zero = (np.concatenate((x, np.empty(len(row), np.int64))) for x in (place, own, zero))
                for d in range(shared, len(row)):
                    nodes.append(row[d])
                    rows.append(0)
                    place[d], own[d], zero[d] = row[d]
                if row:
                    rows[-1] += n
            if cells > HELD_CELLS:
                yield from emit(sums)
                cells = 0
        leave(0)
        yield from emit(sums)

    found = ranged.select("lang", "path", "rows").mapInArrow(run, schema)
    return found.groupBy("lang", "i", "j").agg(F.sum("correction").alias("correction"))


def _groups(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """Every (lang, source): its place among the language's sources, total, zero share; terms and total of the language."""
    totals = rows.select("lang", F.explode("row").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("total"))
    kept = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept", "lang_total"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return groups.withColumns({"place": place, "zero": share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))})


def divergence(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Distances between the sources of each language, and the terms each source stands out by.

    Columns lang, source, part, item, value, rank.  Terms are runs of letters A-Z (lower-cased) and characters beyond
    ASCII; a language keeps the terms that at least ``min_documents`` of its rows hold.  Part ``pair``: item is another
    source of the language, value the sum over all kept terms of the difference of their shares, largest first, all of
    them.  Part ``term``: item is a kept term whose share in the source is above its share in the language, value by how
    much, the ``top`` largest.  Ties go by item in UTF-8 order.

    Null text, lang and source count as empty strings, which are a language and a source like others.  Rows that repeat
    count as often as they are given.  A source without terms has zero counts; a language without kept terms has distances
    of 0 and no terms.  Other columns are ignored.  An empty table gives an empty result.  A term's row and a language's
    report hold an entry per source, as the pair report itself does.
    """
    counts = cut_lineage(term_counts(documents))
    found = counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("row")
    )
    rows = cut_lineage(found.where(F.col("docs") >= min_documents).select("lang", "term", "n", "row"))
    groups = small_side(_groups(counts, rows))
    lang = rows.select("lang", "term", F.col("n").alias("lang_n"), F.explode("row").alias("e"))
    entries = lang.select("lang", "term", "lang_n", "e.source", "e.n").join(groups, ["lang", "source"])
    entries = entries.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    steps = F.sort_array(F.collect_list(F.struct("place", "p", "zero"))).alias("path")
    paths = entries.groupBy("lang", "term").agg(steps).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("rows"))
    together = pair_corrections(cut_lineage(paths))

    side = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("j"), F.col("zero").alias("item_zero"))
    alone = entries.groupBy("lang", F.col("place").alias("i"), "p", "zero").agg(F.count(F.lit(1)).alias("rows"))
    change = F.abs(F.col("p") - F.col("item_zero")) - F.abs(F.col("zero") - F.col("item_zero"))
    alone = alone.join(side, "lang").where("i <> j").groupBy("lang", "i", "j").agg(F.sum(F.col("rows") * change).alias("alone"))
    back = alone.select("lang", F.col("i").alias("j"), F.col("j").alias("i"), F.col("alone").alias("back"))
    together = together.withColumnsRenamed({"i": "low", "j": "high"})

    pairs = groups.select("lang", "source", "kept", "zero", F.col("place").alias("i")).join(side, "lang").where("i <> j")
    pairs = pairs.withColumns({"low": F.least("i", "j"), "high": F.greatest("i", "j")})
    pairs = pairs.join(alone, ["lang", "i", "j"], "left").join(back, ["lang", "i", "j"], "left").join(together, ["lang", "low", "high"], "left")
    base = F.col("kept") * F.abs(F.col("zero") - F.col("item_zero"))
    value = sum((F.coalesce(c, F.lit(0)) for c in (F.col("alone"), F.col("back"), F.col("correction"))), F.coalesce(base, F.lit(0)))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    pairs = pairs.withColumn("rank", rank)

    above = F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = entries.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value")).where("value > 0")
    return pairs.unionByName(first_rows(terms, ["lang", "source"], order, top, "rank"))
