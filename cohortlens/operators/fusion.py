"""Fused cohort scores: descriptor similarity, item score and axis alignment under explicit weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scale
from ..functions.numeric import clamp, labels_or, mean_of, pick, r6
from .axes import AXES
from .scoring import attach

DEFAULT_WEIGHTS = {"descriptor_similarity": 0.35, "image_centroid_score": 0.45, "axis_alignment": 0.20}


def normalised_weights(df: DataFrame, prefix: str = "w_") -> DataFrame:
    """Weight columns ``prefix + component``: missing and negative ones become 0, the rest is divided by the total (or 1)."""
    raw = {k: F.greatest(F.coalesce(F.col(prefix + k).cast("double"), F.lit(0.0)), F.lit(0.0)) for k in DEFAULT_WEIGHTS}
    total = mean_of(*raw.values()) * len(raw)
    divisor = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return df.withColumns({prefix + k: r6(v / divisor) for k, v in raw.items()})


def axis_alignment(expected: str = "hyp_", observed: str = "obs_") -> Column:
    """1 - mean(|delta| / 2) over the eight axes in [0, 1]; 0 if either side has no axes at all."""
    gaps = [F.abs(F.coalesce(F.col(expected + a), F.lit(0.0)) - F.coalesce(F.col(observed + a), F.lit(0.0))) / 2.0 for a in AXES]
    have = [F.coalesce(*[F.col(p + a) for a in AXES]).isNotNull() for p in (expected, observed)]
    return F.when(have[0] & have[1], r6(clamp(F.lit(1.0) - mean_of(*gaps), 0.0, 1.0))).otherwise(0.0)


def unit_score(score: Column) -> Column:
    """Cosine-like score to [0, 1]; missing gives 0."""
    return F.coalesce(r6(clamp((score + 1.0) / 2.0, 0.0, 1.0)), F.lit(0.0))


def improvement_actions() -> Column:
    """Action list from the item score, the axis alignment and the state flags (fixed values)."""
    score, aligned = F.col("image_centroid_score"), F.col("axis_alignment")
    has = lambda flag: F.array_contains("presentation_flags", flag)
    return labels_or(
        "keep_as_baseline_candidate",
        (score.isNull(), "add_or_regenerate_named_sample"),
        (score < 0.1, "regenerate_with_detector_friendly_prompt"),
        ((score >= 0.1) & (score < 0.25), "run_second_seed_and_compare"),
        (aligned < 0.55, "adjust_prompt_to_match_hypothesis_axes"),
        (has("dark_or_underlit_image"), "increase_even_front_lighting"),
        (has("off_center_or_asymmetric_visibility"), "enforce_centered_frontal_crop"),
        (has("dark_upper_band_or_hair_shadow"), "reduce_hair_shadow_over_face"),
        (has("high_texture_or_messy_edges"), "reduce_edge_noise_and_hair_flyaways"),
    )


def fused_cohorts(cohorts: DataFrame, scores: DataFrame, axes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One fused row per cohort.

    ``cohorts``: slug, descriptor_similarity and the hypothesis axes as ``hyp_<axis>``; ``scores``: slug,
    image_centroid_score; ``axes``: slug, the observed axes as ``obs_<axis>``, presentation_flags, quadrant.
    Cohorts without a score or axes stay, as ``partial`` or ``hypothesis_only``.
    """
    raw = {k: max(0.0, float((weights or DEFAULT_WEIGHTS).get(k, 0.0))) for k in DEFAULT_WEIGHTS}
    total = sum(raw.values()) or 1.0
    w = {k: round(v / total, 6) for k, v in raw.items()}
    joined = cohorts.join(scores, "slug", "left").join(axes.withColumn("__axes", F.lit(True)), "slug", "left")
    has_score, has_axes = F.col("image_centroid_score").isNotNull(), F.col("__axes").isNotNull()
    parts = joined.withColumns(
        {
            "normalized_score": unit_score(F.col("image_centroid_score")),
            "axis_alignment": axis_alignment(),
            "presentation_flags": F.coalesce("presentation_flags", F.array(F.lit("missing_image"))),
            "confidence": pick((has_score & has_axes, "measured"), (has_score | has_axes, "partial"), otherwise="hypothesis_only"),
        }
    )
    fused = (
        F.col("descriptor_similarity") * w["descriptor_similarity"]
        + F.col("normalized_score") * w["image_centroid_score"]
        + F.col("axis_alignment") * w["axis_alignment"]
    )
    return parts.withColumns({"enhancement_score": r6(fused), "improvement_actions": improvement_actions()}).drop("__axes")


def fused_ranks(fused: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scale.row_numbers(fused, list(by or []), [F.col("enhancement_score").desc(), F.col("slug").asc()], "rank")


def fused_summary(fused: DataFrame, by: list[str] | None = None) -> DataFrame:
    best = F.struct((-F.col("enhancement_score")).alias("s"), F.col("slug").alias("k"))
    return fused.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("cohort_count"),
        F.count_if(F.col("confidence") == "measured").alias("measured_count"),
        F.min_by("slug", best).alias("top_slug"),
        F.max("enhancement_score").alias("top_score"),
    )


def action_counts(fused: DataFrame, by: list[str] | None = None) -> DataFrame:
    return (
        fused.select(*(by or []), F.explode("improvement_actions").alias("action"))
        .groupBy(*(by or []), "action")
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def top_actions(fused: DataFrame, by: list[str] | None = None, limit: int = 5) -> DataFrame:
    counted = action_counts(fused, by)
    return scale.first_rows(counted, list(by or []), [F.col("uses").desc(), F.col("action").asc()], limit, rank="position")


def cohort_pages(
    fused: DataFrame, config: DataFrame, params: DataFrame, calibration: DataFrame, evidence: DataFrame, risk: DataFrame | None = None
) -> DataFrame:
    """Fused rows with their config, parameters, calibration and evidence; missing evidence gets defaults."""
    rows = fused
    for side in (config, params, calibration, evidence):
        rows = rows.join(side, "slug", "left")
    rows = attach(rows, risk.select("risk_level"), []) if risk is not None else rows.withColumn("risk_level", F.lit(None).cast("string"))
    return rows.withColumns(
        {
            "evidence_type": F.coalesce("evidence_type", F.lit("unverified")),
            "real_item_count": F.coalesce("real_item_count", F.lit(0)),
            "quality_risk": F.coalesce("risk_level", F.lit("unknown")),
            "image": F.concat(F.lit("assets/"), F.col("slug"), F.lit(".png")),
        }
    ).drop("risk_level")
