"""Scores of items against centroids, their summaries, subject reviews and leaderboards."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scale
from ..functions import vectors as vec
from ..functions.numeric import r6

SCORE_COLUMNS = ["cosine_to_mean", "cosine_to_median", "euclidean_to_mean", "euclidean_to_median", "centroid_score"]


HELD_MODELS_BYTES = 16 * 1024 * 1024  # models a kernel may hold; more meet their items in a join


def _against(matrix: np.ndarray, mean: np.ndarray, median: np.ndarray) -> list[np.ndarray]:
    """The score columns of item rows against one centroid pair.

    Equal vectors get equal scores, so that ties stay ties: a BLAS product (``@``) would end in other last bits by the
    row's place in the batch.
    """
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    dots = [np.einsum("ij,j->i", matrix, centre) for centre in (mean, median)]
    columns = [vec.guarded_cosine(dot, norms, np.sqrt(centre @ centre)) for dot, centre in zip(dots, (mean, median))]
    for centre in (mean, median):
        delta = matrix - centre
        columns.append(np.sqrt(np.einsum("ij,ij->i", delta, delta)))
    return [*columns, (columns[0] + columns[1]) / 2.0]


def _held_model_scores(pairs: list[tuple[np.ndarray, np.ndarray]]):
    """Kernel scoring a vector column against centroid pairs it holds, each row against the pair of its number.

    Only the item vectors and the numbers travel to Python; a batch is one matrix product per pair present in it.
    """

    @F.arrow_udf(vec.doubles(SCORE_COLUMNS))
    def score(vectors: pa.Array, numbers: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        which = pc.fill_null(numbers, -1).to_numpy(zero_copy_only=False)
        out, ok = np.zeros((len(SCORE_COLUMNS), len(lengths))), np.zeros(len(lengths), bool)
        for number in np.unique(which[which >= 0]):
            mean, median = pairs[number]
            rows = np.flatnonzero((which == number) & (lengths == len(mean)))
            if len(rows):
                values, _ = vec.flat(vectors.take(pa.array(rows)))
                out[:, rows] = _against(values.reshape(-1, len(mean)), mean, median)
                ok[rows] = True
        return vec.scatter(pa.StructArray.from_arrays([pa.array(c[ok]) for c in out], SCORE_COLUMNS), ok)

    return score


def held_models(models: DataFrame, by: list[str], limit_bytes: int = HELD_MODELS_BYTES) -> tuple[DataFrame, list | None]:
    """Models stored with a number each, and their centroid pairs by number if all are proven to fit ``limit_bytes``."""
    stored = scale.cut_lineage(models.select(*by, F.col("mean_embedding").alias("__mean"), F.col("median_embedding").alias("__median")))
    if scale.size_bytes(stored) > limit_bytes:
        return stored, None
    rows = stored.collect()  # at most ``limit_bytes``
    pairs = [(np.array(r["__mean"], float), np.array(r["__median"], float)) for r in rows]
    named = [tuple(r[c] for c in by) + (i,) for i, r in enumerate(rows)]
    schema = T.StructType([*stored.select(*by).schema.fields, T.StructField("__m", T.IntegerType())])
    return models.sparkSession.createDataFrame(named, schema), pairs


def score_items(items: DataFrame, models: DataFrame, by: list[str] | None = None, vector: str = "embedding") -> DataFrame:
    """Two cosines, two distances and ``centroid_score`` (mean of the cosines) for every item.

    With ``by`` the item is scored against the model of its own group.  The models are stored and measured first: a
    small set is held by the kernel and found by its number, a large one is joined by shuffle.  Without ``by`` there is
    one model (one row, fitted once).  Where the kernel holds the models the scan is map-only.  Vectors travel as stored
    (float32 stays float32 on the way) and are widened in the kernel.  A null key is a group like others; items of a group
    without a model stay, with null scores.
    """
    if not by:
        model = models.select("mean_embedding", "median_embedding").first()
        score = _held_model_scores([(np.array(model["mean_embedding"], float), np.array(model["median_embedding"], float))])
        scored = items.withColumn("__s", score(F.col(vector), F.lit(0)))
        return scored.select("*", *[F.col(f"__s.{c}").alias(c) for c in SCORE_COLUMNS]).drop("__s")
    side, pairs = held_models(models, by)
    if pairs is not None:
        scored = scale.null_safe_keys(items, F.broadcast(side), by).withColumn("__s", _held_model_scores(pairs)(F.col(vector), F.col("__m")))
        return scored.select(*items.columns, *[F.col(f"__s.{c}").alias(c) for c in SCORE_COLUMNS])
    joined = scale.null_safe_keys(items, side, by)
    measured = joined.withColumns(
        {"__a": vec.pair_metrics(vector, "__mean"), "__b": vec.pair_metrics(vector, "__median")}
    )
    return measured.select(
        *items.columns,
        F.col("__a.cosine").alias("cosine_to_mean"),
        F.col("__b.cosine").alias("cosine_to_median"),
        F.col("__a.euclidean").alias("euclidean_to_mean"),
        F.col("__b.euclidean").alias("euclidean_to_median"),
        ((F.col("__a.cosine") + F.col("__b.cosine")) / 2.0).alias("centroid_score"),
    )


def best_first(score: str = "centroid_score", tie: str = "path") -> list[Column]:
    return [F.col(score).desc(), F.col(tie).asc()]


def rank_scores(scores: DataFrame, by: list[str] | None = None, score: str = "centroid_score", tie: str = "path") -> DataFrame:
    """Position in score order.  Only the flat columns are stored and sorted; vectors stay behind."""
    flat = [f.name for f in scores.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType))]
    return scale.row_numbers(scale.settle(scores, flat), list(by or []), best_first(score, tie), "rank")


def best_of(value: str | Column, score: str | Column, tie: str | Column) -> Column:
    """Aggregate: ``value`` of the row with the highest score, the smallest ``tie`` key deciding equal scores."""
    score, tie, value = [F.col(c) if isinstance(c, str) else c for c in (score, tie, value)]
    ordered = F.struct((-score).alias("s"), tie.alias("t"))
    return F.min_by(value, F.when(score.isNotNull(), ordered))


def top_items(scores: DataFrame, by: list[str], limit: int = 5, score: str = "centroid_score", tie: str = "path") -> DataFrame:
    return scale.first_rows(scores, by, best_first(score, tie), limit, rank="rank")


def top_rows(scores: DataFrame, limit: int = 5, score: str = "centroid_score", tie: str = "path") -> DataFrame:
    """Top rows of the whole table: a per-task heap of ``limit`` rows, merged."""
    return scores.orderBy(*best_first(score, tie)).limit(limit)


def score_summary(
    scores: DataFrame, by: list[str], score: str = "centroid_score", item: str = "item_id", tie: str = "path"
) -> DataFrame:
    """Scored and failed counts, best item, mean and exact median per group.  A null score is a failed item."""
    scores = scale.settle(scores, list(dict.fromkeys([*by, item, tie, score])))
    counts = scores.groupBy(*by).agg(
        F.count(score).alias("item_count"),
        F.count_if(F.col(score).isNull()).alias("failed_count"),
        best_of(item, score, tie).alias("best_item_id"),
        r6(F.max(score)).alias(f"best_{score}"),
        r6(F.avg(score)).alias(f"mean_{score}"),
    )
    medians = scale.exact_median(scores, by, score, "__median")
    joined = scale.null_safe_keys(counts, medians, by)
    return joined.withColumn(f"median_{score}", r6("__median")).drop("__median")


def subject_reviews(roster: DataFrame, scores: DataFrame, by: list[str] | None = None, subject: str = "subject") -> DataFrame:
    """One review row per roster subject, empty ones kept with null scores."""
    keys = [*(by or []), subject]
    scores = scale.settle(scores, [*keys, "item_id", "path", "centroid_score", "cosine_to_mean", "cosine_to_median"])
    measured = scores.groupBy(*keys).agg(
        F.count("centroid_score").alias("item_count"),
        F.count_if(F.col("centroid_score").isNull()).alias("failed_count"),
        best_of("item_id", "centroid_score", "path").alias("best_item_id"),
        best_of("path", "centroid_score", "path").alias("best_path"),
        F.max("centroid_score").alias("best_centroid_score"),
        F.avg("centroid_score").alias("mean_centroid_score"),
        F.avg("cosine_to_mean").alias("mean_cosine_to_mean"),
        F.avg("cosine_to_median").alias("mean_cosine_to_median"),
    )
    medians = scale.exact_median(scores, keys, "centroid_score", "median_centroid_score")
    return (
        roster.select(*keys)
        .distinct()
        .join(measured, keys, "left")
        .join(medians, keys, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("item_count", "failed_count")})
    )


def review_order() -> list[Column]:
    """Best mean first; a subject without scores sorts as -1."""
    return [F.coalesce("mean_centroid_score", F.lit(-1.0)).desc(), F.col("subject").asc()]


LEADERBOARDS = {
    "top_mean_subjects": "mean_centroid_score",
    "top_best_subjects": "best_centroid_score",
    "single_image_lift": "lift",
    "mean_vector_leaders": "mean_cosine_to_mean",
    "median_vector_leaders": "mean_cosine_to_median",
}


def leaderboards(reviews: DataFrame, by: list[str] | None = None, limit: int = 5) -> DataFrame:
    """Top subjects of five measures; lift is best minus mean.  Every board keeps ``limit`` rows per task and group."""
    by = list(by or [])
    lifted = reviews.withColumn("lift", F.col("best_centroid_score") - F.col("mean_centroid_score"))
    boards = F.array(*[F.struct(F.lit(n).alias("board"), F.col(m).alias("metric")) for n, m in LEADERBOARDS.items()])
    long = lifted.select(*by, "subject", F.explode(boards).alias("b")).select(*by, "subject", "b.*")
    order = [F.col("metric").desc(), F.col("subject").asc()]
    return scale.first_rows(long.where(F.col("metric").isNotNull()), [*by, "board"], order, limit, rank="rank")


def across_subjects(reviews: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Reviewed and failed totals, mean and median of the subject means."""
    by = list(by or [])
    totals = reviews.groupBy(*by).agg(
        F.sum("item_count").alias("reviewed_count"),
        F.sum("failed_count").alias("failed_count"),
        r6(F.avg("mean_centroid_score")).alias("mean_of_subject_means"),
    )
    medians = scale.exact_median(reviews, by, "mean_centroid_score", "__median")
    return attach(totals, medians, by).withColumn("median_of_subject_means", r6("__median")).drop("__median")


def attach(left: DataFrame, right: DataFrame, by: list[str], rows: bool = False) -> DataFrame:
    """Left join of per-group values; without keys ``right`` has one row.

    ``rows`` says that ``left`` holds item rows, whose groups may be huge: then ``right`` is measured and, if small,
    broadcast, so that the rows are not shuffled by group.
    """
    if by:
        return scale.null_safe_keys(left, scale.small_side(right) if rows else right, by)
    return scale.beside(left, right)


def chunk_assignment(items: DataFrame, chunks: int, by: list[str] | None = None, order: str = "path", key: str = "item_id") -> DataFrame:
    """Contiguous chunks of ceil(n / chunks) items in path order (chunk ids from 0).

    Only ``key`` (one value per item of a group), order and group are stored and ranked; vectors stay where they are.
    """
    if chunks < 1:
        raise ValueError("chunks must be positive")
    by = list(by or [])
    placed = scale.row_numbers(scale.settle(items, [*by, order, key]), by, [F.col(order), F.col(key)], "__rn")
    sizes = placed.groupBy(*by).agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(chunks))).cast("bigint").alias("__size")
    )
    chunk = F.floor((F.col("__rn") - 1) / F.col("__size")).cast("bigint")
    numbered = attach(placed, sizes, by, rows=True).select(*by, key, chunk.alias("chunk"))
    return scale.null_safe_keys(items, scale.small_side(numbered), [*by, key])


def chunk_summaries(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(by or []), "chunk").agg(
        F.count("centroid_score").alias("item_count"),
        F.count_if(F.col("centroid_score").isNull()).alias("failed_count"),
        best_of("item_id", "centroid_score", "path").alias("best_item_id"),
        F.max("centroid_score").alias("best_centroid_score"),
        F.min_by("path", "path").alias("first_path"),
        F.max_by("path", "path").alias("last_path"),
    )


def merged_summary(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Chunk rows merged: counts summed, the best of the bests."""
    return chunks.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.sum("item_count").alias("item_count"),
        F.sum("failed_count").alias("failed_count"),
        best_of("best_item_id", "best_centroid_score", "chunk").alias("best_item_id"),
        r6(F.max("best_centroid_score")).alias("best_centroid_score"),
    )


def failed_sample(items: DataFrame, by: list[str], reason: str = "reason", limit: int = 20) -> DataFrame:
    """Failed rows and, per group, their count and the first ``limit`` paths (the report keeps 20)."""
    failed = items.where(F.col(reason).isNotNull())
    counts = failed.groupBy(*by).agg(F.count(F.lit(1)).alias("failed_count"))
    sample = (
        scale.first_rows(failed, by, [F.col("path")], limit)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list("path")).alias("failed_paths"))
    )
    return attach(counts, sample, by)


def split_failures(items: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their reason)."""
    return items.where(F.col(reason).isNull()), items.where(F.col(reason).isNotNull())


def half_scores(df: DataFrame, first: str, second: str) -> Column:
    """Mean of two scores, null unless both are present."""
    return reduce(lambda a, b: a + b, [F.col(first), F.col(second)]) / 2.0
