"""Exact deduplication over an extendible-hash index kept on shared files.  DataFrame functions only."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scale import cut_lineage, shared_folder, small_side

CAPACITY = 4096  # entries (distinct texts) a bucket holds before it splits


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _chains(documents: DataFrame) -> DataFrame:
    """One row per distinct text: key, text, keep_id and group_size.

    Grouping on (key, text) chains the texts that collide on a key and tells them apart by their bytes.  Every task first
    merges its own copies, so a text that fills a third of the table sends one row per task.
    """
    rows = documents.withColumns({"__text": _text(), "__key": F.xxhash64(_text())})
    return rows.groupBy("__key", "__text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def directory(entries: DataFrame, n_entries: int, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory of an extendible hash table: one row per slot (the leading bits of a key) with bucket and local depth.

    Doubling the directory looks at one more leading bit; a bucket over ``capacity`` splits with it, others stay shared by
    several slots.  A slot's local depth is therefore the first depth at which its bucket fits.  Buckets still over
    capacity at the last depth (many entries with equal leading bits) stay as longer chains.  Returns (directory, depth).
    """
    depth = max(0, math.ceil(math.log2(max(1, n_entries / capacity)))) + 3
    counts = entries.groupBy(F.shiftrightunsigned("__key", 64 - depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    levels = counts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    prefix = F.expr(f"shiftrightunsigned(slot, cast({depth} - level AS int))")
    per_bucket = Window.partitionBy("level", "prefix")
    sized = levels.withColumn("prefix", prefix).withColumn("bucket_n", F.sum("n").over(per_bucket))
    fits = F.when(F.col("bucket_n") <= capacity, F.col("level"))
    slots = sized.groupBy("slot").agg(F.coalesce(F.min(fits), F.lit(depth)).alias("local_depth"))
    free = f"cast({depth} - local_depth AS int)"  # low bits that the bucket does not look at
    return slots.withColumn("bucket", F.expr(f"shiftleft(shiftrightunsigned(slot, {free}), {free})")), depth


def build_index(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Write the index to the shared folder and return it as read back.

    Columns: bucket, local_depth, key, link (place in the key's chain), digest, n_bytes, keep_id, group_size.  Entries are
    dealt to owner tasks by key range, so a bucket lies with one owner (or, over capacity, with neighbours).
    """
    return _build(documents, capacity)[0]


def _build(documents: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, int]:
    """(index as read back, its directory, depth of the directory)."""
    spark = documents.sparkSession
    entries = cut_lineage(
        _chains(documents).select(
            "__key", F.sha2("__text", 256).alias("digest"), F.octet_length("__text").alias("n_bytes"), "keep_id", "group_size"
        )
    )
    slots, depth = directory(entries, entries.count(), capacity)
    slots = small_side(slots)
    placed = entries.withColumn("slot", F.shiftrightunsigned("__key", 64 - depth)).join(slots, "slot").drop("slot")
    chain = Window.partitionBy("__key").orderBy("digest")
    same = F.lag("digest").over(chain) == F.col("digest")
    clash = F.raise_error(F.lit("two different texts share key and digest")).cast("int")
    linked = placed.withColumn("link", F.when(same, clash).otherwise(F.row_number().over(chain)))
    path = f"{shared_folder(spark)}/exact-index-{uuid.uuid4().hex}"
    owned = linked.withColumnRenamed("__key", "key").repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "link")
    owned.write.parquet(path)
    return spark.read.parquet(path), slots, depth


def _look_up(rows: DataFrame, index: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """Rows (key, digest, ...) beside their entry: leading bits of the key give the directory slot, the slot the bucket, and
    the bucket's chain under that key the entry."""
    placed = rows.withColumn("slot", F.shiftrightunsigned("key", 64 - depth)).join(slots.select("slot", "bucket"), "slot").drop("slot")
    return placed.join(index.drop("local_depth", "link"), ["bucket", "key", "digest"])


def group_copies(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every row of ``documents`` (doc_id, text) with the copy that stays.

    Returns doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256 and n_bytes: one row per input row.
    Null text counts as empty, so null and empty texts are copies of each other.  Rows that repeat doc_id and text come
    back as often as they were given, one of them kept.  Rows without doc_id never beat one with an id.  Other columns are
    ignored, whatever their names.  An empty table gives an empty result.
    """
    index, slots, depth = _build(documents.select("doc_id", "text"), capacity)
    rows = documents.select("doc_id", F.xxhash64(_text()).alias("key"), F.sha2(_text(), 256).alias("digest"))
    rows = rows.groupBy("doc_id", "key", "digest").agg(F.count(F.lit(1)).alias("__copies"))
    found = _look_up(rows, index, slots, depth)
    each = found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return each.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"), "n_bytes",
    )


def keep_one(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns: one per distinct text, the one with the largest doc_id.

    Every row is looked up in the index, whose entry names the row that stays.  Null and empty texts are copies of each
    other.  Of rows that tie on doc_id and text, one stays.
    """
    index, slots, depth = _build(documents.select("doc_id", "text"), capacity)
    payload = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("payload")
    rows = documents.select(F.xxhash64(_text()).alias("key"), F.sha2(_text(), 256).alias("digest"), F.col("doc_id").alias("id"), payload)
    kept = _look_up(rows, index, slots, depth).where(F.col("id").eqNullSafe(F.col("keep_id")))
    return kept.groupBy("bucket", "key", "digest").agg(F.first("payload").alias("payload")).select("payload.*")
