"""Centroid stability by bootstrap, null calibration of scores, and the model audit row.

Draws are functions of the seed and their place, not of a generator's state: any engine and any partitioning gives the same ones.
They therefore differ from the stream of a numpy generator with the same seed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scale
from ..functions import vectors as vec
from ..functions.numeric import pick, r6
from .centroids import mean_vectors
from .scoring import attach

STABLE, MODERATE = 0.99, 0.95  # fixed values
NULL_SAMPLES, NULL_SEED = 4096, 260623  # fixed values
NULL_BLOCK = 16_384  # null scores of one model in one array
MODELS_AT_ONCE, SAMPLES_AT_ONCE = 128, 512  # models and samples of one matrix product
_HEX = 13  # hex digits of a draw: 52 bits, exact in a double


def draw(*parts) -> Column:
    """Whole number in [0, 2^52) from the md5 of the parts joined by ``|``."""
    text = F.concat_ws("|", *[(F.lit(p) if not isinstance(p, Column) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _HEX), 16, 10).cast("bigint")


def unit_templates(items: DataFrame, by: list[str], subject: str | None, vector: str = "embedding") -> DataFrame:
    """Bootstrap units: normalised subject means if ``subject`` is given, else the items themselves; null vectors are none."""
    if subject is None:
        return items.select(*by, F.col("item_id").cast("string").alias("unit"), vec.as_vector(vector).alias("template")).where("template IS NOT NULL")
    means = mean_vectors(items, [*by, subject], vector, "template")
    return means.select(*by, F.col(subject).cast("string").alias("unit"), vec.l2_normalise("template").alias("template"))


def stability_band(mean_cosine: Column, units: Column) -> Column:
    return pick(
        (units < 2, "insufficient_units"), (mean_cosine >= STABLE, "stable"), (mean_cosine >= MODERATE, "moderate"), otherwise="unstable"
    )


BUCKET_UNITS = 4096  # units of a bucket, about; a bucket is one task's work at a time
_U = np.uint64


def words(seed: int, resample, node, count) -> np.ndarray:
    """64 random bits for every (resample, node, count): one round of splitmix64 over their weighted sum."""
    parts = [np.asarray(x).astype(_U) for x in (resample, node, count)]
    factors = [_U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93), _U(0x9E3779B97F4A7C15)]
    with np.errstate(over="ignore"):
        x = sum(part * factor for part, factor in zip(parts, factors)) + _U(seed) * _U(0xA0761D6478BD642F)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_SMALL_FACTORIALS = np.array([math.lgamma(k + 1.0) for k in range(64)])


def _log_factorial(x: np.ndarray) -> np.ndarray:
    big = np.maximum(x, 64.0)
    stirling = big * np.log(big) - big + 0.5 * np.log(2 * np.pi * big) + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    return np.where(x < 64, _SMALL_FACTORIALS[np.minimum(x, 63).astype(int)], stirling)


def binomial(draws: np.ndarray, share: float, uniform: np.ndarray) -> np.ndarray:
    """How many of ``draws`` fall to a side that holds ``share`` of the units: the distribution inverted at ``uniform``.

    Only counts within twelve standard deviations are looked at; what lies beyond is less likely than a uniform number can tell.
    """
    if share in (0.0, 1.0):
        return draws * int(share)
    spread = 12 * np.sqrt(draws * share * (1 - share)) + 30
    low = np.maximum(np.floor(draws * share - spread), 0)
    k = low[:, None] + np.arange(int(2 * spread.max()) + 2)
    left = draws[:, None] - k
    inside = left >= 0
    left = np.maximum(left, 0)
    chance = _log_factorial(draws[:, None].astype(float)) - _log_factorial(k) - _log_factorial(left)
    chance = np.where(inside, np.exp(chance + k * math.log(share) + left * math.log1p(-share)), 0.0)
    return np.minimum((low + (np.cumsum(chance, axis=1) < uniform[:, None]).sum(axis=1)).astype(np.int64), draws)


def bucket_draws(sizes: DataFrame, by: list[str], bits: int, resamples: int, seed: int) -> DataFrame:
    """(by, __bucket, draws): how many draws of each resample fall into each bucket, a multinomial over the bucket sizes.

    ``sizes`` holds (by, __bucket, n).  A group's draws are as many as its units; at each of ``bits`` levels a node's draws
    are split in two by a binomial, so there is a row per node with one number per resample, and no row per draw.
    """
    sized = lambda level: sizes.groupBy(*by, F.shiftright("__bucket", bits - level).alias("__node")).agg(F.sum("n").alias("n"))
    nodes = sized(0).select(*by, "__node", F.array_repeat("n", resamples).alias("draws"))
    schema = T.StructType(
        [*sizes.select(*by).schema.fields, T.StructField("__node", T.LongType()), T.StructField("draws", T.ArrayType(T.LongType()))]
    )
    for level in range(bits):
        right = F.col("__node").bitwiseAND(1) == 1
        halves = sized(level + 1).groupBy(*by, F.shiftright("__node", 1).alias("__node")).agg(
            F.sum(F.when(right, 0).otherwise(F.col("n"))).alias("__left"), F.sum("n").alias("__all")
        )

        def split(batches, level=level):
            for batch in batches:
                node, lower, whole = (batch.column(c).to_numpy() for c in ("__node", "__left", "__all"))
                draws = batch.column("draws").flatten().to_numpy().reshape(len(node), resamples)
                rows, names, found = [], [], []
                for i in range(len(node)):
                    uniform = (words(seed, np.arange(resamples), (1 << level) + node[i], 0) >> _U(11)) / 2.0**53
                    taken = binomial(draws[i], lower[i] / whole[i], uniform)
                    for side, part in ((0, taken), (1, draws[i] - taken)):
                        if (lower[i], whole[i] - lower[i])[side]:
                            rows.append(i)
                            names.append(2 * node[i] + side)
                            found.append(part)
                flat = np.concatenate(found) if found else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * resamples), pa.array(flat))
                kept = batch.select(by).take(pa.array(rows, pa.int64())).columns if by else []
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.int64()), lists], names=schema.names)

        nodes = scale.null_safe_keys(nodes, halves, [*by, "__node"]).select(*by, "__node", "__left", "__all", "draws").mapInArrow(split, schema)
    return nodes.withColumnRenamed("__node", "__bucket")


def resampled_cosines(units: DataFrame, by: list[str], resamples: int = 200, seed: int = 0, bits: int | None = None) -> DataFrame:
    """(by, units, resample, cosine): cosine of every resampled centroid to the full one.

    A unit lies in the bucket that the first ``bits`` bits of its hash name (as many as make buckets of about
    ``BUCKET_UNITS`` units of the largest group, if not given).  A group's draws are first split over its buckets; a task
    then draws for the units of a bucket, in their order, and adds up one vector per resample as a matrix product.  Units
    move once, to their bucket; neither drawn rows nor units x resamples rows exist.  ``unit`` names a unit: rows that
    share it lie in one bucket.
    """
    if bits is None:
        largest = units.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
        bits = max(0, math.ceil(math.log2(largest / BUCKET_UNITS)))
    placed = units.withColumn("__bucket", F.shiftright(draw(F.lit("bucket"), F.col("unit")), 4 * _HEX - bits))
    sizes = scale.cut_lineage(placed.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("n")))
    counts = sizes.groupBy(*by).agg(F.sum("n").alias("units"))
    draws = bucket_draws(sizes, by, bits, resamples, seed)
    schema = T.StructType(
        [*units.select(*by).schema.fields, T.StructField("resample", T.IntegerType()), T.StructField("total", vec.VECTOR)]
    )

    def add_up(key, members: pa.Table, drawn: pa.Table) -> pa.Table:
        bucket, members = key[-1].as_py(), members.sort_by("unit")
        n, times = members.num_rows, drawn.column("draws").combine_chunks().flatten().to_numpy()
        templates = members.column("template").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        totals = np.zeros((resamples, templates.shape[1]))
        for at in range(0, resamples, 32):  # draws of some resamples at once
            part = times[at : at + 32]
            resample = np.repeat(np.arange(at, at + len(part)), part)
            count = np.arange(len(resample)) - np.repeat(np.cumsum(part) - part, part)
            picked = ((words(seed, resample, (1 << bits) + bucket, count) >> _U(11)) % _U(n)).astype(np.int64)
            weights = np.bincount((resample - at) * n + picked, minlength=len(part) * n).reshape(len(part), n)
            totals[at : at + len(part)] = weights @ templates
        keys = [pa.array([k.as_py()] * resamples, k.type) for k in key[:-1]]
        return pa.Table.from_arrays(
            [*keys, pa.array(np.arange(resamples, dtype=np.int32)), vec.list_array(totals.ravel(), np.arange(resamples + 1) * templates.shape[1])],
            names=schema.names,
        )

    members = placed.select(*by, "__bucket", "unit", "template").groupBy(*by, "__bucket")
    sums = members.cogroup(draws.groupBy(*by, "__bucket")).applyInArrow(add_up, schema)
    centres = sums.groupBy(*by, "resample").agg(vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("__centre"))
    full = mean_vectors(units, by, "template", "__full")
    joined = attach(attach(centres, full, by), counts, by)
    return joined.select(*by, "units", "resample", vec.cosine("__centre", "__full").alias("cosine"))


def centroid_stability(
    items: DataFrame, by: list[str], subject: str | None = None, resamples: int = 200, ci: float = 0.95, seed: int = 0,
    bits: int | None = None,
) -> DataFrame:
    """Bootstrap self-similarity of the centroid per group: mean, interval, spread and band.

    A group of fewer than two units has nothing to resample: cosines are 1 and the band is ``insufficient_units``.
    """
    if resamples < 1 or not 0.0 < ci < 1.0:
        raise ValueError("resamples must be positive and ci between 0 and 1")
    units = unit_templates(items, by, subject)
    cosines = scale.settle(resampled_cosines(units, by, resamples, seed, bits))
    stats = cosines.groupBy(*by, "units").agg(F.avg("cosine").alias("__mean"), F.stddev_pop("cosine").alias("__std"))
    limits = scale.exact_percentiles(cosines, by, "cosine", {"__low": (1 - ci) / 2, "__high": (1 + ci) / 2})
    joined = attach(stats, limits, by)
    few = F.col("units") < 2
    return joined.select(
        *by,
        F.lit("subject" if subject else "item").alias("unit"),
        F.col("units").alias("unit_count"),
        F.when(few, 0).otherwise(resamples).cast("bigint").alias("resamples"),
        F.when(few, 1.0).otherwise(r6("__mean")).alias("self_cosine_mean"),
        F.when(few, 1.0).otherwise(r6("__low")).alias("self_cosine_low"),
        F.when(few, 1.0).otherwise(r6("__high")).alias("self_cosine_high"),
        F.when(few, 0.0).otherwise(r6("__std")).alias("self_cosine_std"),
        stability_band(F.col("__mean"), F.col("units")).alias("band"),
    )


def _normals(samples: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Standard normals, a row per sample: Box-Muller over two words of 52 bits for every component."""
    u, v = ((words(seed, samples[:, None], np.arange(width)[None], count) >> _U(12)) / 2.0**52 for count in (0, 1))
    return np.sqrt(-2.0 * np.log(u + 2.0**-52)) * np.cos(2.0 * 3.141592653589793 * v)


def _scores_of_block(first: int, count: int, means: np.ndarray, medians: np.ndarray, seed: int) -> np.ndarray:
    """Centroid score of samples ``first`` .. ``first + count - 1`` (columns) against some models of one width (rows)."""
    scores = np.zeros((len(means), count))
    for at in range(0, count, SAMPLES_AT_ONCE):
        drawn = _normals(np.arange(first + at, first + min(count, at + SAMPLES_AT_ONCE)), means.shape[1], seed)
        lengths = np.sqrt(np.einsum("ij,ij->i", drawn, drawn))[None]
        for centres in (means, medians):
            norms = np.sqrt(np.einsum("ij,ij->i", centres, centres))[:, None]
            scores[:, at : at + len(drawn)] += vec.guarded_cosine(centres @ drawn.T, norms, lengths) / 2.0
    return scores


def _null_arrays(models: DataFrame, by: list[str], samples: int, seed: int, in_order: bool) -> DataFrame:
    """(by, __first, null_scores): one array per model and block of samples, sorted if ``in_order``, else by sample.

    Map-only: a task scores its own models, ``MODELS_AT_ONCE`` of them as one matrix product per block of samples, and
    draws the samples where it needs them, so neither models nor samples travel.
    """
    rows = models.select(
        *by, F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(NULL_BLOCK))).alias("__first"),
        vec.as_vector("mean_embedding").alias("__mean"), vec.as_vector("median_embedding").alias("__median"),
    )
    schema = T.StructType([*rows.select(*by, "__first").schema.fields, T.StructField("null_scores", vec.VECTOR)])

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        means, medians = batch.column("__mean"), batch.column("__median")
        widths, others = (pc.fill_null(pc.list_value_length(c), -1).to_numpy(zero_copy_only=False) for c in (means, medians))
        widths = np.where((widths == others) & (widths > 0), widths, 0)
        firsts = batch.column("__first").to_numpy(zero_copy_only=False)
        counts = np.where(widths > 0, np.minimum(NULL_BLOCK, samples - firsts), 0)
        starts = np.concatenate(([0], np.cumsum(counts)))
        values = np.empty(starts[-1])
        for width, first in sorted(set(zip(widths[widths > 0].tolist(), firsts[widths > 0].tolist()))):
            same = np.flatnonzero((widths == width) & (firsts == first))
            centres = [vec.flat(side.take(pa.array(same)))[0].reshape(-1, width) for side in (means, medians)]
            found = _scores_of_block(first, int(counts[same[0]]), *centres, seed)
            if in_order:
                found.sort(axis=1)
            values[starts[same][:, None] + np.arange(found.shape[1])] = found
        usable = widths > 0
        lists = vec.list_array(values, np.concatenate(([0], np.cumsum(counts[usable]))))
        return pa.RecordBatch.from_arrays([*batch.select([*by, "__first"]).columns, vec.scatter(lists, usable)], names=schema.names)

    def kernel(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, MODELS_AT_ONCE):
                yield score(batch.slice(at, MODELS_AT_ONCE))

    return rows.mapInArrow(kernel, schema)


def null_scores(models: DataFrame, by: list[str], samples: int = NULL_SAMPLES, seed: int = NULL_SEED) -> DataFrame:
    """Centroid scores of random unit vectors against every model, a row each: (by, sample, null_score).

    A model without vectors, or whose two vectors differ in width, has no rows.
    """
    blocks = _null_arrays(models, by, samples, seed, in_order=False)
    rows = blocks.select(*by, "__first", F.posexplode("null_scores").alias("__at", "null_score"))
    return rows.select(*by, (F.col("__first") + F.col("__at")).alias("sample"), "null_score")


def null_distribution(models: DataFrame, by: list[str], samples: int = NULL_SAMPLES, seed: int = NULL_SEED) -> DataFrame:
    """(by, null_scores): the same scores as one sorted array per model, of ``samples`` numbers; null for an unusable model.

    Up to ``NULL_BLOCK`` samples nothing is shuffled; more come as sorted blocks and are merged per model.  ``by`` names a
    model; null keys are keys like others.
    """
    blocks = _null_arrays(models, by, samples, seed, in_order=True)
    if samples <= NULL_BLOCK:
        return blocks.drop("__first")
    merged = F.array_sort(F.flatten(F.collect_list("null_scores")))
    return blocks.groupBy(*by).agg(F.when(F.count("null_scores") > 0, merged).alias("null_scores"))


_NULL_PROBS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@F.arrow_udf(vec.doubles(["null_mean", "null_std", *_NULL_PROBS]))
def _distribution_stats(scores: pa.Array) -> pa.Array:
    ok = scores.is_valid().to_numpy(zero_copy_only=False)
    values, starts = vec.flat(scores.filter(pa.array(ok)))
    counts = np.diff(starts)
    mean = vec.row_sums(values, starts) / counts
    spread = np.sqrt(vec.row_sums((values - np.repeat(mean, counts)) ** 2, starts) / counts)
    cuts = []
    for p in _NULL_PROBS.values():
        place = p * (counts - 1)
        low = np.floor(place).astype(np.int64)
        below, above = values[starts[:-1] + low], values[starts[:-1] + np.minimum(low + 1, counts - 1)]
        cuts.append(below + (above - below) * (place - low))
    names = ["null_mean", "null_std", *_NULL_PROBS]
    return vec.scatter(pa.StructArray.from_arrays([pa.array(c) for c in (mean, spread, *cuts)], names), ok)


@F.arrow_udf(T.DoubleType())
def _share_at_most(scores: pa.Array, observed: pa.Array) -> pa.Array:
    ok = (scores.is_valid().to_numpy(zero_copy_only=False)) & (observed.is_valid().to_numpy(zero_copy_only=False))
    keep = pa.array(ok)
    values, starts = vec.flat(scores.filter(keep))
    wanted = observed.filter(keep).to_numpy(zero_copy_only=False)
    below = [np.searchsorted(values[a:b], x, "right") / (b - a) for a, b, x in zip(starts[:-1], starts[1:], wanted)]
    return vec.scatter(pa.array(np.array(below, float)), ok)


def null_summary(nulls: DataFrame, by: list[str]) -> DataFrame:
    """Mean, spread and p50 / p90 / p95 / p99 of every model's sorted null scores (``null_distribution``), looked up in place."""
    told = nulls.select(*by, F.coalesce(F.array_size("null_scores"), F.lit(0)).cast("bigint").alias("sample_count"), _distribution_stats("null_scores").alias("__s"))
    return told.select(*by, "sample_count", *[r6(f"__s.{c}").alias(c) for c in ("null_mean", "null_std", *_NULL_PROBS)])


def observed_percentiles(nulls: DataFrame, observed: DataFrame, by: list[str], scores: list[str]) -> DataFrame:
    """Share of null scores at or below each observed score, found in the model's sorted scores (``null_distribution``).

    ``observed`` has one row per group; a missing score, or a model without null scores, has a null share.
    """
    joined = attach(nulls, observed.select(*by, *scores), by)
    return joined.select(*by, *[r6(_share_at_most("null_scores", F.col(s).cast("double"))).alias(f"{s}_percentile") for s in scores])


def model_audit(models: DataFrame, stability: DataFrame, by: list[str]) -> DataFrame:
    """One audit row per model: norms and digests of both centroids, how they differ, and the bootstrap result."""
    pair = vec.pair_metrics("mean_embedding", "median_embedding")
    rows = models.withColumn("__p", pair).select(
        *by, "item_count", "embedding_dim",
        r6(vec.l2_norm("mean_embedding")).alias("mean_l2_norm"), r6(vec.l2_norm("median_embedding")).alias("median_l2_norm"),
        vec.text_digest(F.col("mean_embedding")).alias("mean_digest"), vec.text_digest(F.col("median_embedding")).alias("median_digest"),
        *[r6(f"__p.{m}").alias(f"mean_median_{m}") for m in vec.PAIR_FIELDS],
    )
    return attach(rows, stability.select(*by, "unit_count", "self_cosine_mean", "band"), by)
