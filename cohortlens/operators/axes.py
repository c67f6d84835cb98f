"""Descriptor axes: nine descriptors to eight bounded axes, labels, state flags, condition strata, and a 2-D projection."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scale
from ..functions.numeric import labels_or, mean_of, pick, r6, rescale
from .scoring import attach

# Axis names, descriptor names, and per descriptor the bounds of its scale and its default if missing.
AXES = [
    "soft_defined", "cool_warm", "deep_bright", "natural_styled",
    "muted_vivid", "soft_crisp", "light_dark_hair", "dynamic_symmetric",
]
DESCRIPTOR_SCALES = {
    "contrast": (0.04, 0.24, 0.0),
    "edge_density": (0.01, 0.12, 0.0),
    "luminance": (0.35, 0.82, 0.5),
    "saturation": (0.02, 0.22, 0.0),
    "warmth": (-0.08, 0.08, 0.0),
    "symmetry": (0.75, 0.99, 0.85),
    "upper_band_darkness": (0.05, 0.48, 0.2),
    "middle_luminance": (0.35, 0.82, 0.5),
    "lower_luminance": (0.35, 0.82, 0.5),
}
DESCRIPTORS = list(DESCRIPTOR_SCALES)


def descriptor_columns(df: DataFrame, column: str) -> DataFrame:
    """A descriptor map as nine columns: null where the key is missing, 0 where its value is not a number."""
    m = F.col(column)
    return df.select(
        *[c for c in df.columns if c != column],
        *[F.when(F.map_contains_key(m, k), F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0.0))).alias(k) for k in DESCRIPTORS],
    )


def axis_columns(prefix: str = "") -> dict[str, Column]:
    """The eight axes as column expressions over nine descriptor columns named ``prefix + descriptor``."""
    s = {
        name: rescale(F.coalesce(F.col(prefix + name), F.lit(default)), low, high)
        for name, (low, high, default) in DESCRIPTOR_SCALES.items()
    }
    return {
        "soft_defined": r6(mean_of(s["contrast"], s["edge_density"])),
        "cool_warm": r6(s["warmth"]),
        "deep_bright": r6(mean_of(s["luminance"], s["middle_luminance"], s["lower_luminance"])),
        "natural_styled": r6(mean_of(s["contrast"], s["saturation"])),
        "muted_vivid": r6(s["saturation"]),
        "soft_crisp": r6(s["edge_density"]),
        "light_dark_hair": r6(s["upper_band_darkness"]),
        "dynamic_symmetric": r6(s["symmetry"]),
    }


def add_axes(df: DataFrame) -> DataFrame:
    return df.withColumns(axis_columns())


def flags() -> Column:
    """State flags of an image from its axes."""
    a = {name: F.col(name) for name in AXES}
    return labels_or(
        "no_major_presentation_flags",
        (a["deep_bright"] <= -0.55, "dark_or_underlit_image"),
        (a["soft_defined"] >= 0.70, "high_contrast_or_heavy_definition"),
        (a["soft_crisp"] >= 0.70, "high_texture_or_messy_edges"),
        (a["dynamic_symmetric"] <= -0.45, "off_center_or_asymmetric_visibility"),
        ((a["light_dark_hair"] >= 0.75) & (a["deep_bright"] <= -0.20), "dark_upper_band_or_hair_shadow"),
        (a["natural_styled"] >= 0.70, "strong_styling_or_makeup_signal"),
    )


def outlier_score() -> Column:
    return r6(mean_of(*[F.abs(F.col(a)) for a in AXES]))


def add_distribution(df: DataFrame) -> DataFrame:
    """Quadrant, corner, cross label, flags and outlier score of rows with axis columns."""
    x, y = F.col("quadrant_x"), F.col("quadrant_y")
    placed = df.withColumns(
        {
            "quadrant_x": r6(mean_of(F.col("soft_defined"), F.col("natural_styled"))),
            "quadrant_y": r6(mean_of(F.col("deep_bright"), F.col("cool_warm"))),
            "cross_x": F.col("dynamic_symmetric"),
            "cross_y": F.col("light_dark_hair"),
        }
    )
    horizontal = F.when(F.col("cross_x") >= 0, "symmetric").otherwise("dynamic")
    vertical = F.when(F.col("cross_y") >= 0, "dark_hair").otherwise("light_hair")
    return placed.withColumns(
        {
            "quadrant": pick(
                ((x >= 0) & (y >= 0), "defined_bright"), (y >= 0, "soft_bright"), (x < 0, "soft_deep"), otherwise="defined_deep"
            ),
            "corner": pick(
                ((x >= 0.33) & (y >= 0.33), "defined_warm_bright_corner"),
                ((x <= -0.33) & (y >= 0.33), "soft_clear_bright_corner"),
                ((x <= -0.33) & (y <= -0.33), "soft_muted_deep_corner"),
                ((x >= 0.33) & (y <= -0.33), "defined_cool_deep_corner"),
                otherwise="center_cross",
            ),
            "cross_label": F.concat_ws("_", horizontal, vertical),
            "presentation_flags": flags(),
            "outlier_score": outlier_score(),
        }
    )


def axis_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Axis means per group and the labels of the mean point."""
    means = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("item_count"), *[r6(F.avg(a)).alias(a) for a in AXES])
    return add_distribution(means)


def label_counts(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    return rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("item_count"))


def add_conditions(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Resolution, aspect, lighting and crop buckets, and one tag per bucket and flag."""
    short = F.least(F.col(width), F.col(height))
    aspect = F.when(F.col(height) != 0, F.col(width) / F.nullif(F.col(height), F.lit(0))).otherwise(0.0)
    has = lambda flag: F.array_contains("presentation_flags", flag)
    buckets = df.withColumns(
        {
            "aspect_ratio": r6(aspect),
            "resolution_bucket": pick((short < 512, "small"), (short < 1024, "medium"), otherwise="large"),
            "aspect_bucket": pick(
                (aspect <= 0, "unknown"), (aspect < 0.85, "portrait"), (aspect > 1.15, "landscape"), otherwise="squareish"
            ),
            "lighting": F.when(has("dark_or_underlit_image"), "underlit").otherwise("lighting_ok"),
            "crop_quality": F.when(has("off_center_or_asymmetric_visibility"), "off_center").otherwise("centered"),
        }
    )
    fixed = [("resolution", "resolution_bucket"), ("aspect", "aspect_bucket"), ("lighting", "lighting"), ("crop", "crop_quality")]
    tags = F.concat(
        F.array(*[F.concat(F.lit(f"{name}:"), F.col(c)) for name, c in fixed]),
        F.transform(F.array_sort(F.array_distinct("presentation_flags")), lambda f: F.concat(F.lit("presentation:"), f)),
    )
    return buckets.withColumn("condition_tags", tags)


def condition_strata(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per condition tag: rows, axis means and mean outlier score."""
    tagged = rows.select(*(by or []), F.explode("condition_tags").alias("tag"), *AXES, "outlier_score")
    return tagged.groupBy(*(by or []), "tag").agg(
        F.count(F.lit(1)).alias("item_count"),
        *[r6(F.avg(a)).alias(a) for a in AXES],
        r6(F.avg("outlier_score")).alias("mean_outlier_score"),
    )


_PAIRS = list(combinations_with_replacement(range(len(AXES)), 2))


def axis_covariance(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: row count, the 8 axis means and the 36 distinct population covariances, in one aggregate."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("item_count"),
        F.array(*[F.avg(a) for a in AXES]).alias("axis_means"),
        F.array(*[F.covar_pop(AXES[i], AXES[j]) for i, j in _PAIRS]).alias("covariances"),
    )


def _principal_axes(frames):
    """Two leading eigenvectors of each group's 8x8 covariance; the largest loading of each is made positive."""
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            matrix = np.zeros((len(AXES), len(AXES)))
            for (i, j), value in zip(_PAIRS, row.covariances):
                matrix[i, j] = matrix[j, i] = value
            values, columns = np.linalg.eigh(matrix)
            leading = columns[:, ::-1][:, :2].T
            leading = leading * np.sign(leading[np.arange(2), np.abs(leading).argmax(axis=1)])[:, None]
            explained = values[::-1][:2] / max(values.sum(), 1e-300)
            usable = row.item_count >= 2 and np.sqrt(max(values.sum(), 0.0) * row.item_count) >= 1e-12
            reason = None if usable else ("requires_at_least_two_images" if row.item_count < 2 else "no_axis_variance")
            out.append((leading[0].tolist(), leading[1].tolist(), explained.tolist(), reason))
        extra = pd.DataFrame(out, columns=["loadings_1", "loadings_2", "explained", "unavailable_reason"])
        yield pd.concat([frame.drop(columns=["covariances"]).reset_index(drop=True), extra], axis=1)


def principal_axes(rows: DataFrame, by: list[str]) -> DataFrame:
    """PCA per group.  Spark reduces the rows to one covariance per group; only those 8x8 matrices meet numpy."""
    covariance = axis_covariance(rows, by).where("item_count > 0")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in covariance.schema if f.name != "covariances"]
    added = ["loadings_1 array<double>", "loadings_2 array<double>", "explained array<double>", "unavailable_reason string"]
    return covariance.mapInPandas(_principal_axes, ", ".join(kept + added))


def adaptive_projection(rows: DataFrame, by: list[str], item: str = "item_id") -> DataFrame:
    """Rows projected on their group's two principal axes, each coordinate scaled by the group's largest magnitude.

    Rows of a group without two axes are left out.  A null key is a group like others; without ``by`` all rows are one.
    """
    axes = principal_axes(rows, by).where(F.col("unavailable_reason").isNull())
    joined = attach(rows.select(*by, item, *AXES), axes, by, rows=True).where(F.col("loadings_1").isNotNull())

    def coordinate(loadings: str) -> Column:
        terms = [(F.col(a) - F.get("axis_means", F.lit(i))) * F.get(loadings, F.lit(i)) for i, a in enumerate(AXES)]
        return mean_of(*terms) * len(AXES)

    raw = joined.select(*by, item, coordinate("loadings_1").alias("__x"), coordinate("loadings_2").alias("__y"))
    spans = raw.groupBy(*by).agg(F.max(F.abs("__x")).alias("__sx"), F.max(F.abs("__y")).alias("__sy"))
    floor = F.lit(1e-12)
    return attach(raw, spans, by, rows=True).select(
        *by, item,
        r6(F.col("__x") / F.greatest("__sx", floor)).alias("adaptive_x"),
        r6(F.col("__y") / F.greatest("__sy", floor)).alias("adaptive_y"),
    )


def flat_axis_table(rows: DataFrame, projection: DataFrame, keys: list[str]) -> DataFrame:
    """One flat row per item for a CSV sink: labels, lists joined with ``;``, projection left-joined by id."""
    return (
        scale.null_safe_keys(rows, projection, keys)
        .withColumn("presentation_flags", F.array_join("presentation_flags", ";"))
        .withColumn("condition_tags", F.array_join("condition_tags", ";"))
        .select(
            *keys, "quadrant", "corner", "quadrant_x", "quadrant_y", "cross_label", "outlier_score", "presentation_flags",
            "condition_tags", "width", "height", "aspect_ratio", "adaptive_x", "adaptive_y", "cross_x", "cross_y", *AXES,
        )
    )
