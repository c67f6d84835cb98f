"""Scores against channel engagement: wide dataset, correlations with p-values, labels and rankings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scale
from ..functions.numeric import pick, sum_known
from .agreement import moment_correlation

METRICS = ["followers", "posts", "total_engagement", "engagement_rate"]


def channel_columns(engagement: DataFrame, channels: dict[str, str], order: str, key: str = "subject") -> DataFrame:
    """Long engagement rows to one row per subject with ``<prefix>_<metric>`` columns; the last row of a channel wins.

    A conditional aggregate per channel: duplicates shrink map-side, nothing is collected.
    """
    latest = {
        prefix: F.max_by(F.struct(*METRICS), F.when(F.col("channel") == channel, F.col(order))) for channel, prefix in channels.items()
    }
    wide = engagement.groupBy(key).agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col(order))).alias("name"),
                                       *[c.alias(f"__{p}") for p, c in latest.items()])
    return wide.select(key, "name", *[F.col(f"__{p}.{m}").alias(f"{p}_{m}") for p in latest for m in METRICS])


def correlation_dataset(scores: DataFrame, wide: DataFrame, prefixes: list[str], key: str = "subject") -> DataFrame:
    """Full outer join on the subject with total and largest followers over the channels present."""
    scored = scores.withColumn("__scored", F.col(key))
    joined = scored.join(wide, key, "full")
    followers = [F.col(f"{p}_followers") for p in prefixes]
    return joined.withColumns(
        {
            "name": F.coalesce("name", "__scored"),
            "total_followers": sum_known(*followers),
            "max_followers": F.greatest(*followers),
        }
    ).drop("__scored")


def pair_rows(dataset: DataFrame, score_columns: list[str], metric_columns: list[str], key: str = "subject") -> DataFrame:
    """(variable_a, variable_b, key, a, b) for every score x metric pair, complete rows only."""
    pairs = [
        F.struct(F.lit(s).alias("variable_a"), F.lit(m).alias("variable_b"), F.col(s).cast("double").alias("a"), F.col(m).cast("double").alias("b"))
        for s in score_columns
        for m in metric_columns
    ]
    rows = dataset.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*")
    return rows.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def _declared(dataset: DataFrame, score_columns: list[str], metric_columns: list[str]) -> DataFrame:
    names = [(s, m) for s in score_columns for m in metric_columns]
    return dataset.sparkSession.createDataFrame(names, "variable_a string, variable_b string")


PAIR = ["variable_a", "variable_b"]


def correlations(dataset: DataFrame, score_columns: list[str], metric_columns: list[str], key: str = "subject", spearman: bool = True) -> DataFrame:
    """Pearson and average-rank Spearman per pair; pairs with fewer than three complete rows stay, without values."""
    rows = pair_rows(scale.settle(dataset, [key, *score_columns, *metric_columns]), score_columns, metric_columns, key)
    measures = [F.count(F.lit(1)).alias("n"), moment_correlation("a", "b").alias("pearson_r")]
    if spearman:
        rows = scale.settle(rows)
        rows = scale.average_ranks(scale.average_ranks(rows, PAIR, "a", "rank_a"), PAIR, "b", "rank_b")
        measures.append(moment_correlation("rank_a", "rank_b").alias("spearman_r"))
    measured = rows.groupBy(*PAIR).agg(*measures)
    values = [c for c in measured.columns if c.endswith("_r")]
    joined = _declared(dataset, score_columns, metric_columns).join(measured, PAIR, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= 3
    return joined.withColumns({c: F.when(enough, F.col(c)) for c in values})


def _beta_tail(x: np.ndarray, a: np.ndarray, b: float) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by its continued fraction (Lentz), using the symmetric side that converges."""
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    log_gamma = np.vectorize(math.lgamma)
    with np.errstate(divide="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1.0 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    total = d.copy()
    for m in range(1, 300):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1.0 / np.where(np.abs(1 + top * d) < tiny, tiny, 1 + top * d)
            c = np.where(np.abs(1 + top / c) < tiny, tiny, 1 + top / c)
            total = total * d * c
    value = front * total
    return np.where(swap, 1.0 - value, value)


@F.pandas_udf(T.DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation from Student's t with n - 2 degrees of freedom."""
    freedom = n.astype(float) - 2.0
    valid = r.notna() & (freedom > 0)
    out = pd.Series(np.nan, index=r.index)
    if valid.any():
        rr, df = r[valid].clip(-1, 1).to_numpy(float), freedom[valid].to_numpy(float)
        x = np.clip(1.0 - rr * rr, 0.0, 1.0)  # df / (df + t^2) with t^2 = df r^2 / (1 - r^2)
        out[valid] = np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, _beta_tail(np.clip(x, 1e-300, 1 - 1e-16), df / 2.0, 0.5)))
    return out.where(valid, None)


def with_p_values(result: DataFrame) -> DataFrame:
    return result.withColumns({"pearson_p": p_value("pearson_r", "n"), "spearman_p": p_value("spearman_r", "n")})


def interpretation(r: Column, p: Column | None = None, n: Column | None = None) -> Column:
    """Strength and direction, with * below p = .05 and + below .1."""
    size = F.abs(r)
    strength = pick((size >= 0.7, "strong"), (size >= 0.4, "moderate"), (size >= 0.2, "weak"), otherwise="negligible")
    direction = F.when(r >= 0, "_positive").otherwise("_negative")
    mark = F.lit("") if p is None else pick((p < 0.05, "*"), (p < 0.1, "+"), otherwise="")
    label = F.when(r.isNull() | F.isnan(r), "no_data").otherwise(F.concat(strength, direction, mark))
    return label if n is None else F.when(n < 3, "insufficient_data").otherwise(label)


def correlation_report(result: DataFrame) -> DataFrame:
    """Rounded to four decimals and labelled."""
    tested = with_p_values(result)
    label = interpretation(F.col("spearman_r"), F.col("spearman_p"), F.col("n"))
    return tested.withColumn("interpretation", label).withColumns(
        {c: F.round(c, 4) for c in ("pearson_r", "pearson_p", "spearman_r", "spearman_p")}
    )


def dataset_coverage(dataset: DataFrame, columns: dict[str, str], by: list[str] | None = None) -> DataFrame:
    return dataset.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("subject_count"), *[F.count(c).alias(n) for n, c in columns.items()])


def strongest_first(result: DataFrame) -> DataFrame:
    """Position by absolute Spearman, missing as 0 (the table has one row per declared pair)."""
    from pyspark.sql.window import Window

    order = Window.orderBy(F.coalesce(F.abs("spearman_r"), F.lit(0.0)).desc(), "variable_a", "variable_b")
    return result.withColumn("position", F.row_number().over(order))


def score_ranking(dataset: DataFrame, score: str, key: str = "subject") -> DataFrame:
    """Subjects by score, missing as 0."""
    return scale.row_numbers(dataset, [], [F.coalesce(score, F.lit(0.0)).desc(), F.col(key).asc()], "position")


def top_pair(result: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The pair with the largest absolute Spearman among finite values; NaN never wins and is reported as null."""
    finite = F.when(~F.isnan("spearman_r") & (F.abs("spearman_r") != float("inf")), F.col("spearman_r"))
    clean = result.withColumn("spearman_r", finite)
    best = F.struct((-F.abs("spearman_r")).alias("s"), F.col("variable_a").alias("a"), F.col("variable_b").alias("b"))
    order = F.when(F.col("spearman_r").isNotNull(), best)
    return clean.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("correlation_count"),
        *[F.min_by(c, order).alias(f"top_{c}") for c in ("variable_a", "variable_b", "n", "spearman_r")],
    )
