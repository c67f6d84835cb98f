"""Calibration of fused cohort rows: gaps to targets, priority, axis corrections and a seed plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scale
from ..functions.numeric import pick, r6
from .axes import AXES

TARGETS = {"image_centroid_score": 0.35, "axis_alignment": 0.62, "enhancement_score": 0.76}

# Axis, the clause to lower it, the clause to raise it, the descriptors it is made of.
AXIS_RULES = [
    ("soft_defined", "softer lower-contrast facial separation", "more defined facial separation", ["contrast", "edge_density"]),
    ("cool_warm", "cooler neutral skin balance", "warmer skin balance", ["warmth"]),
    ("deep_bright", "deeper shaded tone", "brighter airy tone", ["luminance", "middle_luminance", "lower_luminance"]),
    ("natural_styled", "more natural styling", "more visibly styled makeup", ["contrast", "saturation"]),
    ("muted_vivid", "more muted color", "more vivid color", ["saturation"]),
    ("soft_crisp", "softer hairline and silhouette", "crisper hairline detail", ["edge_density"]),
    ("light_dark_hair", "lighter upper hair band", "darker upper hair band", ["upper_band_darkness"]),
    ("dynamic_symmetric", "more dynamic asymmetry", "more centered symmetry", ["symmetry"]),
]

# Improvement action -> note.
ACTION_NOTES = {
    "regenerate_with_detector_friendly_prompt": "use a cleaner detector-friendly frontal portrait composition",
    "run_second_seed_and_compare": "run multiple seeds and retain only the best centroid/axis candidate",
    "adjust_prompt_to_match_hypothesis_axes": "prioritize the hypothesis axis corrections over decorative styling",
    "increase_even_front_lighting": "increase even front lighting and reduce underexposure",
    "enforce_centered_frontal_crop": "center the face with both eyes clearly visible",
    "reduce_hair_shadow_over_face": "keep hair away from the face and reduce upper-face shadows",
    "reduce_edge_noise_and_hair_flyaways": "reduce flyaway hair and over-sharpened edges",
    "keep_as_baseline_candidate": "keep this prompt as a baseline control",
    "add_or_regenerate_named_sample": "create a named agency sample before scoring",
}


def gap(target: float, value: Column) -> Column:
    """How far below the target; a missing value is the whole target away."""
    return F.when(value.isNull(), F.lit(float(target))).otherwise(F.greatest(F.lit(0.0), F.lit(float(target)) - value))


def add_gaps(fused: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """gap_<component>, the priority they give in order, and the intensity of the largest."""
    wanted = targets or TARGETS
    gaps = {f"gap_{k}": r6(gap(t, F.col(k))) for k, t in wanted.items()}
    largest = F.greatest(*gaps)
    return fused.withColumns(gaps).withColumns(
        {
            "priority": pick(
                (F.col("gap_image_centroid_score") >= 0.25, "regenerate"),
                (F.col("gap_axis_alignment") >= 0.20, "axis_calibration"),
                (F.col("gap_enhancement_score") >= 0.08, "seed_sweep"),
                otherwise="baseline_control",
            ),
            "intensity": pick((largest >= 0.30, "high"), (largest >= 0.15, "medium"), otherwise="low"),
        }
    )


def _axes_present(prefix: str) -> Column:
    return F.coalesce(*[F.col(prefix + a) for a in AXES]).isNotNull()


def axis_delta_rows(fused: DataFrame, keys: list[str], expected: str = "hyp_", observed: str = "obs_") -> DataFrame:
    """expected - observed per axis, over the axes either side has."""
    def entry(axis: str) -> Column:
        e, o = F.col(expected + axis), F.col(observed + axis)
        delta = r6(F.coalesce(e, F.lit(0.0)) - F.coalesce(o, F.lit(0.0)))
        return F.when(F.coalesce(e, o).isNotNull(), F.struct(
            F.lit(axis).alias("axis"), delta.alias("axis_delta"), e.alias("hypothesis_axis"), o.alias("observed_axis")))

    rows = fused.select(*keys, F.explode(F.array(*[entry(a) for a in AXES])).alias("e"))
    return rows.where(F.col("e").isNotNull()).select(*keys, "e.*")


def attribution_rows(fused: DataFrame, keys: list[str], offsets: str = "offsets") -> DataFrame:
    """Axis rows worth correcting: |delta| of at least .25 or a non-zero offset among the axis's descriptors."""
    def entry(axis: str, low: str, high: str, sources: list[str]) -> Column:
        e, o = F.col(f"hyp_{axis}"), F.col(f"obs_{axis}")
        delta = r6(F.coalesce(e, F.lit(0.0)) - F.coalesce(o, F.lit(0.0)))
        used = F.map_filter(
            F.coalesce(F.col(offsets), F.create_map().cast("map<string,double>")), lambda k, v: k.isin(*sources) & (v != 0)
        )
        return F.when((F.abs(delta) >= 0.25) | (F.size(used) > 0), F.struct(
            F.lit(axis).alias("axis"), F.transform_values(used, lambda k, v: r6(v)).alias("descriptor_delta"),
            delta.alias("axis_delta"), F.when(delta > 0, high).otherwise(low).alias("clause"),
            r6(e).alias("hypothesis_axis"), r6(o).alias("observed_axis")))

    rows = fused.select(*keys, F.explode(F.array(*[entry(*rule) for rule in AXIS_RULES])).alias("e"))
    return rows.where(F.col("e").isNotNull()).select(*keys, "e.*")


def axis_notes() -> Column:
    """Correction clauses of the axes that are off by at least .25, with fallbacks."""
    clauses = []
    for axis, low, high, _ in AXIS_RULES:
        delta = F.coalesce(F.col(f"hyp_{axis}"), F.lit(0.0)) - F.coalesce(F.col(f"obs_{axis}"), F.lit(0.0))
        clauses.append(F.when(F.abs(delta) >= 0.25, F.when(delta > 0, high).otherwise(low)))
    found = F.filter(F.array(*clauses), lambda x: x.isNotNull())
    return pick(
        (~(_axes_present("hyp_") & _axes_present("obs_")), F.array(F.lit("collect a measured image sample for this agency"))),
        (F.size(found) == 0, F.array(F.lit("keep current visual axis balance"))),
        otherwise=found,
    )


def action_notes(actions: str = "improvement_actions") -> Column:
    """Note of each action, the action itself where no note is known."""
    known = F.create_map(*[F.lit(x) for pair in ACTION_NOTES.items() for x in pair])
    notes = F.transform(actions, lambda a: F.coalesce(F.try_element_at(known, a), a))
    return F.when(F.size(actions) == 0, F.array(F.lit("keep as baseline control"))).otherwise(notes)


def seed_plan(calibrated: DataFrame, seed_start: int = 260623, variants: int = 3, by: list[str] | None = None) -> DataFrame:
    """seed = start + index * variants, in rank order."""
    placed = scale.row_numbers(calibrated, list(by or []), [F.col("rank").asc(), F.col("slug").asc()], "__rn")
    return placed.withColumn("seed", F.lit(seed_start) + (F.col("__rn") - 1) * variants).drop("__rn")


def calibration_summary(calibrated: DataFrame, by: list[str] | None = None) -> DataFrame:
    counts = [F.count_if(F.col("priority") == p).alias(p) for p in ("regenerate", "axis_calibration", "seed_sweep", "baseline_control")]
    return calibrated.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("cohort_count"), *counts)


def regenerate_first(calibrated: DataFrame) -> DataFrame:
    """Cohorts to regenerate first, as rows in rank order (a list column would grow with the table)."""
    return calibrated.where(F.col("priority").isin("regenerate", "axis_calibration"))
