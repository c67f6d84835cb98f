"""Mean and median centroids, subject vectors, cohort centroids, and summaries of the vectors themselves."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scale
from ..functions import vectors as vec
from ..functions.medians import element_medians
from ..functions.numeric import pick, r6


def mean_vectors(df: DataFrame, by: list[str], vector: str, name: str, extra: list | None = None) -> DataFrame:
    """Element-wise mean per group: one mergeable buffer of d doubles per group and task, no exploded rows."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(vec.as_vector(vector)))).alias(name)
    return df.where(F.col(vector).isNotNull()).groupBy(*by).agg(mean, *(extra or []))


def median_vectors(df: DataFrame, by: list[str], vector: str, name: str) -> DataFrame:
    """Element-wise exact median per group (midpoint of the middle two)."""
    return element_medians(df, by, vector, name)


def _join_on(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return scale.null_safe_keys(left, right, by)
    return scale.beside(left, right)


def mean_and_median(
    df: DataFrame, by: list[str], vector: str, mean: str, median: str, unit: bool, extra: list | None = None
) -> DataFrame:
    """Both centres per group; ``extra`` aggregates ride along in the pass of the mean."""
    joined = _join_on(mean_vectors(df, by, vector, mean, extra=extra), median_vectors(df, by, vector, median), by)
    if not unit:
        return joined
    return joined.withColumns({mean: vec.l2_normalise(mean), median: vec.l2_normalise(median)})


def centroid_models(
    items: DataFrame,
    by: list[str] | None = None,
    mode: str = "image_weighted",
    subject: str = "subject",
    vector: str = "embedding",
    pixels: str | None = None,
) -> DataFrame:
    """One centroid model per ``by`` group.

    ``image_weighted`` averages the items; ``subject_balanced`` first averages each subject (normalised) and then the
    subjects, so an item-heavy subject counts once.  Embedding centroids are L2-normalised, pixel centroids are not.
    """
    by = list(by or [])
    if mode not in ("image_weighted", "subject_balanced"):
        raise ValueError(f"unsupported centroid mode: {mode}")
    width = F.max(F.size(vector)).alias("embedding_dim")
    if mode == "image_weighted":
        units, unit_pixels = items, items
        extra = [F.count(F.lit(1)).alias("item_count"), width]
    else:
        count = [F.count(F.lit(1)).alias("__items")]
        units = mean_vectors(items, [*by, subject], vector, vector, extra=count).withColumn(vector, vec.l2_normalise(vector))
        unit_pixels = mean_vectors(items, [*by, subject], pixels, pixels) if pixels else None
        extra = [F.sum("__items").alias("item_count"), F.count(F.lit(1)).alias("subject_count"), width]
    model = mean_and_median(units, by, vector, "mean_embedding", "median_embedding", True, extra)
    model = model.withColumn("centroid_mode", F.lit(mode))
    if not by:
        model = model.where(F.col("item_count") > 0)
    if pixels:
        looks = mean_and_median(unit_pixels, by, pixels, "mean_appearance", "median_appearance", False)
        model = _join_on(model, looks, by)
    return model


def subject_counts(items: DataFrame, by: list[str] | None = None, subject: str = "subject") -> DataFrame:
    return items.groupBy(*(by or []), subject).agg(F.count(F.lit(1)).alias("item_count"))


def subject_vectors(roster: DataFrame, items: DataFrame, subject: str = "subject", vector: str = "embedding") -> DataFrame:
    """One row per roster subject: ``ok`` with its centroid, ``empty`` without items, ``failed`` if no item was readable.

    A null ``vector`` marks an item that could not be read.
    """
    good = items.where(F.col(vector).isNotNull())
    counts = items.groupBy(subject).agg(
        F.count(vector).alias("item_count"), F.count_if(F.col(vector).isNull()).alias("failed_count")
    )
    centroids = mean_and_median(good, [subject], vector, "mean_embedding", "median_embedding", True)
    named = scale.null_safe_keys(roster.select(subject).distinct(), counts, [subject])
    joined = scale.null_safe_keys(named, centroids, [subject])
    status = (
        F.when(F.col("item_count") > 0, "ok").when(F.col("failed_count") > 0, "failed").otherwise("empty")
    )
    return joined.select(
        subject,
        status.alias("status"),
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
        F.coalesce("failed_count", F.lit(0)).alias("failed_count"),
        F.when(F.col("item_count") > 0, F.size("mean_embedding")).alias("embedding_dim"),
        "mean_embedding",
        "median_embedding",
    )


def subject_vector_manifest(vectors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals by status; never raw values."""
    return vectors.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("subject_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("ok", "empty", "failed")],
    )


def subject_vector_rows(vectors: DataFrame, subject: str = "subject") -> DataFrame:
    """Per-subject manifest rows: norms and digests only."""
    return vectors.select(
        subject,
        "status",
        "item_count",
        "failed_count",
        "embedding_dim",
        r6(vec.l2_norm("mean_embedding")).alias("mean_l2_norm"),
        vec.text_digest(F.col("mean_embedding")).alias("mean_digest"),
        vec.text_digest(F.col("median_embedding")).alias("median_digest"),
    )


def cohort_centroids(members: DataFrame, by: list[str], subject: str = "subject") -> DataFrame:
    """Centroid of the members' mean vectors; every member counts once whatever its item count."""
    ready = members.where(F.col("mean_embedding").isNotNull())
    counted = ready.groupBy(*by).agg(F.count(F.lit(1)).alias("subject_count"))
    return _join_on(counted, mean_and_median(ready, by, "mean_embedding", "mean_centroid", "median_centroid", True), by)


def vector_summary(df: DataFrame, keys: list[str], vector: str, exact_bytes: bool = False) -> DataFrame:
    """Width, norm, digest and the first eight values of a vector column."""
    values = vec.as_vector(vector)
    digest = vec.float32_digest(values) if exact_bytes else vec.text_digest(values)
    return df.select(
        *keys,
        F.size(vector).alias("width"),
        r6(vec.l2_norm(values)).alias("l2_norm"),
        digest.alias("digest"),
        vec.at_six_decimals(F.slice(values, 1, 8)).alias("preview"),
    )


def pair_summary(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Cosine, distance, mean and largest absolute delta; unavailable if a side is missing or the widths differ."""
    metrics = vec.pair_metrics(vec.as_vector(left), vec.as_vector(right))
    measured = df.withColumn("__m", metrics)
    return measured.select(
        *keys,
        F.col("__m").isNotNull().alias("available"),
        F.when(F.size(left) != F.size(right), F.lit("shape mismatch")).alias("error"),
        *[r6(f"__m.{m}").alias(m) for m in ("cosine", "euclidean", "mean_abs_delta", "max_abs_delta")],
    )


def descriptor_delta(left: DataFrame, right: DataFrame, keys: list[str], keep_missing: bool = False) -> DataFrame:
    """left - right per descriptor over the union of names.

    Inputs are long rows (keys, name, value).  Pairs with a missing side are dropped, or kept as null on request.
    """
    joined = left.withColumnRenamed("value", "__l").join(right.withColumnRenamed("value", "__r"), [*keys, "name"], "full")
    delta = joined.select(*keys, "name", r6(F.col("__l") - F.col("__r")).alias("delta"))
    return delta if keep_missing else delta.where(F.col("delta").isNotNull())


def map_rows(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A name -> number map column as long rows (keys, name, value)."""
    return df.select(*keys, F.explode(column).alias("name", "value"))


def export_rows(models: DataFrame, keys: list[str], vectors: list[str], shapes: dict[str, list[int]] | None = None) -> DataFrame:
    """Vectors as long rows (vector, index, value, shape, dtype, l2_norm, digest), ready for a CSV or JSON sink.

    ``shapes`` names the dimensions of vectors that are grids (an appearance of 64 x 64 x 3), written ``64x64x3``; others are
    written with their length.  A vector whose length is not that of its shape is an error.
    """
    named = [(k, F.lit("x".join(map(str, d))), math.prod(d)) for k, d in (shapes or {}).items()]
    wrong = lambda k: F.raise_error(F.lit(f"{k} does not have the length of its shape"))
    shape = pick(
        *[((F.col("vector") == k), F.when(F.size("values") == n, text).otherwise(wrong(k))) for k, text, n in named],
        otherwise=F.size("values").cast("string"),
    ) if named else F.size("values").cast("string")
    long = models.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(v).alias("vector"), F.col(v).alias("values")) for v in vectors])).alias("e")
    ).select(*keys, F.col("e.vector").alias("vector"), F.col("e.values").alias("values"))
    described = long.withColumns(
        {
            "shape": shape,
            "dtype": F.lit("float64"),
            "l2_norm": r6(vec.l2_norm("values")),
            "digest": vec.text_digest(F.col("values")),
        }
    )
    return described.select(
        *keys, "vector", F.posexplode("values").alias("index", "value"), "shape", "dtype", "l2_norm", "digest"
    )


def grid_position(index, dims) -> Column:
    """Coordinates of a flat index (from 0) in a grid of ``dims``, last dimension fastest."""
    index, dims = (F.col(c) if isinstance(c, str) else c for c in (index, dims))
    behind = lambda i: F.aggregate(F.slice(dims, i + 2, F.size(dims)), F.lit(1), lambda a, d: a * d)
    return F.transform(dims, lambda d, i: F.floor(index / behind(i)).cast("int") % d)


def read_back_export(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Exported rows back to one row per vector: value count, parsed shape (null if it does not parse), norm, digest."""
    parsed = F.filter(F.split("shape", "x"), lambda s: s != "")
    sizes = F.transform(parsed, lambda s: s.try_cast("int"))
    return (
        rows.where(F.col("vector").isNotNull() & (F.col("vector") != ""))
        .groupBy(*keys, "vector")
        .agg(
            F.count(F.lit(1)).alias("values_count"),
            *[F.first(c).alias(c) for c in ("shape", "dtype", "l2_norm", "digest")],
        )
        .withColumn("dims", F.when(F.forall(sizes, lambda s: s.isNotNull()) & (F.length("shape") > 0), sizes))
    )
