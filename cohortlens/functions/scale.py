"""Building blocks that keep one hot key from becoming one hot task.

* ``exact_percentiles`` - exact interpolated percentiles without gathering a group's values in one place.
* ``row_numbers`` / ``average_ranks`` - ranks inside groups of any size, by range partitioning and offsets.
* ``small_side`` - broadcast a join side only after its size has been measured.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
WINDOW_LIMIT_ROWS = 2_000_000  # rows of one group a window may hold
_ROW_BITS = 33  # monotonically_increasing_id keeps the row position of a partition in the low 33 bits


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where the session names none (tests)."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="cohortlens-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read stored rows, so a lost executor cannot change them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores if the scan has fewer splits than cores (small files before costly per-row work).

    A table with enough splits is returned as it is: no shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def beside(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row frame (a global aggregate) put beside every row of ``left``.

    A broadcast of exactly one row rather than a scalar subquery: Spark cannot pass a subquery into a Python kernel.
    """
    return left.join(F.broadcast(one_row), F.lit(True), "left")


def settle(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Store only the columns later passes need.

    Ranks and percentiles read their input more than once.  Settled rows are read back from storage, so a costly or wide
    input (scores of wide vectors) is computed once, and every pass sees the same last bits.
    """
    return cut_lineage(df.select(*columns) if columns else df)


def small_side(df: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES, store: bool = True) -> DataFrame:
    """Store ``df``, measure it, and mark it for broadcast only if it is under the limit.

    Over the limit the stored rows come back unmarked and Catalyst joins them by shuffle (AQE splits skewed keys).
    ``store=False`` skips the storing where computing ``df`` again is cheap and exact (integer sums over stored rows).
    """
    stored = cut_lineage(df) if store else df
    return F.broadcast(stored) if size_bytes(stored) <= limit_bytes else stored


def size_bytes(df: DataFrame) -> int:
    """Size of all rows as JSON text."""
    return df.agg(_json_bytes(df).alias("bytes")).first()["bytes"]


def _json_bytes(df: DataFrame) -> Column:
    """Aggregate: size of all rows as JSON text."""
    width = F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    return F.coalesce(F.sum(width.cast("bigint")), F.lit(0))


def null_safe_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` where null equals null; the key columns of ``right`` are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, condition, "left").drop(*[f"__r_{k}" for k in keys])


def exact_percentiles(
    df: DataFrame, by: list[str], value: Column | str, probs: dict[str, float], accuracy: int = 10000
) -> DataFrame:
    """Exact linear-interpolation percentiles per group: columns ``by`` + one column per entry of ``probs``.

    Two mergeable passes instead of one unbounded buffer per group:
    1. a bounded sketch brackets every wanted rank within +-2/accuracy of the group;
    2. values outside the brackets shrink map-side to one counted row per gap, values inside to one counted row per
       distinct value, and a running count over those few rows picks the order statistics.  The largest group is known
       from pass 1; if even its share inside the brackets is too much for a window, the count runs range-partitioned.
    The second pass raises if a wanted rank were to fall outside its bracket, so a result is exact or an error.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, value.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    margin = 2.0 / accuracy
    cuts: list[float] = []
    for p in probs.values():
        cuts += [max(0.0, p - margin), min(1.0, p + margin)]
    brackets = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", cuts, accuracy).alias("__cut")
    )
    # ``value`` may be computed anew in pass 2, where sums can differ in the last bits: widen each bracket by 1e-9 of itself.
    outward = lambda x, i: x + F.abs(x) * F.when(i % 2 == 0, -1e-9).otherwise(1e-9)
    brackets = brackets.withColumn("__cut", F.transform("__cut", outward))
    stored = cut_lineage(brackets)
    size = stored.agg(_json_bytes(stored).alias("bytes"), F.max("__n").alias("largest")).first()
    if by:
        side = F.broadcast(stored) if size["bytes"] <= BROADCAST_LIMIT_BYTES else stored
        marked = null_safe_keys(rows, side, by)
    else:
        marked = beside(rows, stored)
    inside_rows = (size["largest"] or 0) * 2 * margin * len(probs)
    v = F.col("__v")
    inside = reduce(
        lambda a, b: a | b,
        [v.between(F.element_at("__cut", 2 * i + 1), F.element_at("__cut", 2 * i + 2)) for i in range(len(probs))],
    )
    gap = reduce(
        lambda a, b: a + b, [(v > F.element_at("__cut", i + 1)).cast("int") for i in range(len(cuts))]
    )
    counted = (
        marked.withColumn("__gap", F.when(~inside, gap))
        .groupBy(*by, "__n", "__gap", F.when(inside, v).alias("__exact"))
        .agg(F.count(F.lit(1)).alias("__c"), F.min(v).alias("__low"))
    )
    if inside_rows <= WINDOW_LIMIT_ROWS:
        running = Window.partitionBy(*by).orderBy("__low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counted.withColumn("__cum", F.sum("__c").over(running))
    else:
        placed = running_totals(counted, by, [F.col("__low")], "__c", "__cum")
    placed = placed.withColumn("__prev", F.col("__cum") - F.col("__c"))
    missed = F.raise_error(F.lit("percentile rank fell outside its bracket")).cast("double")

    def order_statistic(rank: Column) -> Column:
        here = (F.col("__prev") <= rank) & (rank < F.col("__cum"))
        exact = F.when(F.col("__exact").isNull() & (F.col("__c") > 1), missed).otherwise(F.col("__low"))
        return F.max(F.when(here, exact))

    aggregates = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("__n") - 1)
        aggregates += [
            order_statistic(F.floor(position)).alias(f"__lo_{name}"),
            order_statistic(F.ceil(position)).alias(f"__hi_{name}"),
        ]
    picked = placed.groupBy(*by, "__n").agg(*aggregates)
    results = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        results.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return picked.select(*by, *results)


def exact_median(df: DataFrame, by: list[str], value: Column | str, name: str = "median") -> DataFrame:
    return exact_percentiles(df, by, value, {name: 0.5})


def row_numbers(df: DataFrame, by: list[str], order: list[Column], name: str = "row_number") -> DataFrame:
    """1-based position of each row in its group, in ``order``, for groups that do not fit one task.

    Rows are range-partitioned on (by, order), numbered inside their partition, and stored; only one count per
    (partition, group) is then summed up to give every partition its starting number.  No window ever spans a group.
    The input is read twice (once to sample the ranges): ``settle`` it first if computing it is costly.
    """
    keys = [F.col(c) for c in by]
    sorted_rows = df.repartitionByRange(*keys, *order) if keys or order else df
    numbered = cut_lineage(
        sorted_rows.sortWithinPartitions(*keys, *order).withColumn("__seq", F.monotonically_increasing_id())
    ).withColumn("__pid", F.shiftright("__seq", _ROW_BITS))
    spans = numbered.groupBy(*by, "__pid").agg(F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    side = small_side(offsets, store=False) if by else F.broadcast(offsets)  # without groups: one row per partition
    joined = null_safe_keys(numbered, side, [*by, "__pid"])
    return joined.withColumn(name, F.col("__seq") - F.col("__first") + F.col("__before") + 1).drop(
        "__seq", "__pid", "__first", "__before"
    )


def running_totals(df: DataFrame, by: list[str], order: list[Column], amount: str, name: str) -> DataFrame:
    """Running sum of ``amount`` in each group, in ``order``, for groups that do not fit one task.

    As ``row_numbers``: range partitions summed up to offsets, and windows only inside one partition of one group.
    """
    keys = [F.col(c) for c in by]
    ranged = df.repartitionByRange(*keys, *order).withColumn("__pid", F.spark_partition_id())
    stored = cut_lineage(ranged)
    spans = stored.groupBy(*by, "__pid").agg(F.sum(amount).alias("__total"))
    before = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(*by, "__pid", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    side = small_side(offsets, store=False) if by else F.broadcast(offsets)
    local = Window.partitionBy(*by, "__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = stored.withColumn("__local", F.sum(amount).over(local))
    joined = null_safe_keys(summed, side, [*by, "__pid"])
    return joined.withColumn(name, F.col("__local") + F.col("__before")).drop("__pid", "__local", "__before")


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Rank of ``value`` in its group, ties sharing their average rank (first and last position of the tie, halved).

    Ties are counted before anything moves, so a value that most rows share is one row; ranks follow from running totals
    over the distinct values.  ``df`` is read twice: ``settle`` it first if computing it is costly.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    placed = running_totals(counts, by, [F.col(value)], "__c", "__cum")
    ranks = placed.select(*by, value, (F.col("__cum") - (F.col("__c") - 1) / 2.0).alias(name))
    return null_safe_keys(df, small_side(ranks, store=False), [*by, value])


def first_rows(df: DataFrame, by: list[str], order: list[Column], limit: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``limit`` rows of each group.  Spark prunes each task to ``limit`` rows per group before the shuffle."""
    column = rank or "__rn"
    ranked = df.withColumn(column, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = ranked.where(F.col(column) <= limit)
    return kept if rank else kept.drop(column)
