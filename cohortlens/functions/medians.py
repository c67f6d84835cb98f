"""Exact element-wise medians of vector columns, from counts in mergeable arrays; no row per element is ever made.

1. A group's rows are sampled down to what one task may hold.  A sample that is the whole group gives its medians at once.
2. For other groups the sample brackets every position's median, and one pass counts the values of each position in
   ``BINS`` equal bins of its bracket, below and above it: one array per group and task, added up before it moves.
3. A second pass keeps only the values of the bins the middle ranks fall into, counted by value.

The sample decides how much is kept in the last pass, never the result: a middle rank outside its bracket is looked up
among the values there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import scale
from . import vectors as vec

SAMPLE_BYTES = 32 * 1024 * 1024  # vectors of a group held by one task
SAMPLE_ROWS = 8192
BINS = 256
FLUSH_BYTES = 64 * 1024 * 1024  # counts or values a task holds before it passes them on
_ROOM = 1.3  # a group of up to this times the sample's rows is taken whole


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0), kind))


def _sampled(rows: DataFrame, by: list[str], sample_rows: int) -> DataFrame:
    """(by, n, whole, low, high): medians twice where the sample is the whole group, else the bracket of each position."""
    schema = T.StructType(
        [*rows.select(*by).schema.fields, T.StructField("n", T.LongType()), T.StructField("whole", T.BooleanType()),
         T.StructField("low", vec.VECTOR), T.StructField("high", vec.VECTOR)]
    )

    def bracket(key, table):
        n, held = table.column("__n")[0].as_py(), table.num_rows
        values = _matrix(table.column("__v"))
        if held == n:
            low = high = np.median(values, axis=0)
        else:
            margin = 6 * np.sqrt(held) / 2 + 1  # six standard errors of the middle rank
            ranks = [int(max(0, held / 2 - margin)), int(min(held - 1, held / 2 + margin))]
            low, high = np.partition(values, sorted(set(ranks)), axis=0)[ranks]
        keys = [pa.array([k.as_py()], k.type) for k in key]
        columns = [*keys, pa.array([n]), pa.array([held == n]), _lists([low], pa.float64()), _lists([high], pa.float64())]
        return pa.Table.from_arrays(columns, names=schema.names)

    return rows.groupBy(*by).applyInArrow(bracket, schema)


def _bins(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bin of every value of [rows, positions]: 0 below its bracket, ``BINS`` + 1 above, one of equal bins inside."""
    width = high - low
    inside = np.floor((values - low) * np.where(width > 0, BINS / np.where(width > 0, width, 1.0), 0.0))
    return np.where(values < low, 0, np.where(values <= high, 1 + np.minimum(inside, BINS - 1), BINS + 1)).astype(np.int64)


def _histograms(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, counts): values per position and bin, positions one after the other; rows carry low and high."""
    schema = T.StructType([*rows.select(*by).schema.fields, T.StructField("counts", vec.VECTOR)])

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def drain():
            keys = [pa.array([k[i] for k in held], f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*keys, _lists(list(held.values()), pa.float64())], names=schema.names)
            held.clear()

        for batch in batches:
            arrow = batch.schema.empty_table().select(by).schema
            for key, part in _by_group(batch, by):
                values, low, high = (_matrix(part.column(c)) for c in ("__v", "low", "high"))
                d = values.shape[1]
                cell = _bins(values, low[0], high[0]) + np.arange(d) * (BINS + 2)
                counts = held.setdefault(key, np.zeros(d * (BINS + 2)))
                counts += np.bincount(cell.ravel(), minlength=len(counts))
            if sum(c.nbytes for c in held.values()) > FLUSH_BYTES:
                yield from drain()
        if held:
            yield from drain()

    counted = rows.mapInArrow(run, schema)
    return counted.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector("counts"))).alias("counts"))


def _by_group(batch: pa.RecordBatch, by: list[str]):
    """Rows of a batch, group by group."""
    if not by:
        yield (), batch
        return
    keys = list(zip(*[batch.column(c).to_pylist() for c in by]))
    places: dict[tuple, list[int]] = {}
    for row, key in enumerate(keys):
        places.setdefault(key, []).append(row)
    for key, rows in places.items():
        yield key, batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))


def _middle_bins(counted: DataFrame) -> DataFrame:
    """Adds first, last (bins of the two middle ranks, by position) and before (values below the first) for counts and n."""

    @F.arrow_udf(T.StructType([T.StructField("first", T.ArrayType(T.LongType())), T.StructField("last", T.ArrayType(T.LongType())), T.StructField("before", T.ArrayType(T.LongType()))]))
    def middle(counts: pa.Array, n: pa.Array) -> pa.Array:
        found = [[], [], []]
        for row, rows in zip(counts, n.to_pylist()):
            # the summarizer adds up as mean times weight, which may end just beside the whole number
            until = np.cumsum(np.rint(row.values.to_numpy()).astype(np.int64).reshape(-1, BINS + 2), axis=1)
            first, last = ((until <= rank).sum(axis=1) for rank in ((rows - 1) // 2, rows // 2))
            before = np.where(first > 0, until[np.arange(len(first)), np.maximum(first - 1, 0)], 0)
            for out, values in zip(found, (first, last, before)):
                out.append(values)
        return pa.StructArray.from_arrays([_lists(x, pa.int64()) for x in found], ["first", "last", "before"])

    return counted.withColumn("__m", middle("counts", "n")).select("*", "__m.*").drop("__m", "counts")


def _middle_values(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, pos, value, c): the values in the bins of the middle ranks, counted."""
    schema = T.StructType(
        [*rows.select(*by).schema.fields, T.StructField("pos", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("c", T.LongType())]
    )

    def run(batches):
        for batch in batches:
            arrow = batch.schema.empty_table().select(by).schema
            for key, part in _by_group(batch, by):
                values, low, high = (_matrix(part.column(c)) for c in ("__v", "low", "high"))
                first, last = (part.column(c).slice(0, 1).flatten().to_numpy() for c in ("first", "last"))
                cell = _bins(values, low[0], high[0])
                row, pos = np.nonzero((cell >= first) & (cell <= last))
                pairs = np.stack((pos.astype(np.float64), values[row, pos]), axis=1)
                distinct, c = np.unique(pairs, axis=0, return_counts=True)
                keys = [pa.array([k] * len(c), f.type) for k, f in zip(key, arrow)]
                columns = [*keys, pa.array(distinct[:, 0].astype(np.int32)), pa.array(distinct[:, 1]), pa.array(c.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema).groupBy(*by, "pos", "value").agg(F.sum("c").alias("c"))


def element_medians(df: DataFrame, by: list[str], vector: str, name: str, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(by, name): element-wise exact median per group, the midpoint of the middle two.  Null vectors are left out.

    A null key is a group like others.  All vectors of a group have one width and no null elements.  ``df`` is read twice,
    and twice more if a group is larger than a sample: settle it first if computing it is costly.
    """
    rows = df.where(F.col(vector).isNotNull()).select(*by, vec.as_vector(vector).alias("__v"))
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.max(F.size("__v")).alias("__d"))
    counts = scale.cut_lineage(counts if by else counts.where("__n > 0"))
    largest = counts.agg(F.max("__n").alias("n"), F.max("__d").alias("d")).first()
    sample_rows = max(64, min(SAMPLE_ROWS, sample_bytes // (8 * max(largest["d"] or 1, 1))))
    whole = (largest["n"] or 0) <= _ROOM * sample_rows
    sized = _with(rows, counts.drop("__d"), by)
    if not whole:
        rate = F.when(F.col("__n") <= _ROOM * sample_rows, 1.0).otherwise(F.lit(float(sample_rows)) / F.col("__n"))
        sized = sized.where(F.rand(17) < rate)
    sampled = _sampled(sized, by, sample_rows)
    if whole:
        return sampled.select(*by, F.col("low").alias(name))
    sampled = scale.cut_lineage(sampled)  # random: drawn once, read by every pass
    open_groups = sampled.where(~F.col("whole")).drop("whole")
    counted = _histograms(_with(rows, open_groups.drop("n"), by, inner="low"), by)
    middle = scale.cut_lineage(_middle_bins(_with(counted, open_groups, by)))
    values = _middle_values(_with(rows, middle.drop("n", "before"), by, inner="low"), by)
    running = Window.partitionBy(*by, "pos").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _with(values.withColumn("__until", F.sum("c").over(running)), middle.select(*by, "n", "before"), by)
    until = F.col("__until") + F.get("before", F.col("pos"))
    at = lambda rank: F.max(F.when((until - F.col("c") <= rank) & (rank < until), F.col("value")))
    picked = placed.groupBy(*by, "pos").agg(at(F.floor((F.col("n") - 1) / 2)).alias("a"), at(F.floor(F.col("n") / 2)).alias("b"))
    median = F.col("a") + (F.col("b") - F.col("a")) * 0.5
    ordered = F.array_sort(F.collect_list(F.struct("pos", median.alias("m"))))  # one entry per position
    large = picked.groupBy(*by).agg(F.transform(ordered, lambda e: e["m"]).alias(name))
    return sampled.where("whole").select(*by, F.col("low").alias(name)).unionByName(large.where(F.size(name) > 0))


def _with(rows: DataFrame, groups: DataFrame, by: list[str], inner: str | None = None) -> DataFrame:
    """Columns of a row's group beside it; ``inner`` names one that must be there."""
    joined = scale.null_safe_keys(rows, scale.small_side(groups, store=False), by) if by else scale.beside(rows, groups)
    return joined.where(F.col(inner).isNotNull()) if inner else joined
