"""Cohort parameters: descriptor offsets over a base, distance to the base, and descriptor summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scale
from ..functions.numeric import clamp, mean_of, pick, r6
from .scoring import attach

# Descriptor keys in their reporting order.
DESCRIPTOR_KEYS = [
    "luminance", "contrast", "saturation", "warmth", "symmetry",
    "edge_density", "upper_band_darkness", "middle_luminance", "lower_luminance",
]


def known_descriptors(column: str) -> Column:
    """Text map -> number map: known descriptor keys whose value is a number."""
    numbers = F.transform_values(column, lambda k, v: v.try_cast("double"))
    return F.map_filter(numbers, lambda k, v: k.isin(*DESCRIPTOR_KEYS) & v.isNotNull())


def clamped(key: str, value: Column) -> Column:
    return clamp(value, -1.0 if key == "warmth" else 0.0, 1.0)


def average_descriptors(cohorts: DataFrame, base: DataFrame, offsets: str = "offsets", by: list[str] | None = None) -> DataFrame:
    """base + offset per descriptor, clamped and rounded; a missing offset or base value counts as 0.

    ``base`` has one row (or one per ``by`` key) with a descriptor column each; it arrives as ``base_<key>``.
    """
    named = base.select(*(by or []), *[F.col(k).alias(f"base_{k}") for k in DESCRIPTOR_KEYS])
    joined = attach(cohorts, named, list(by or []), rows=True)
    return joined.withColumns(
        {
            key: r6(clamped(key, F.coalesce(F.col(f"base_{key}"), F.lit(0.0)) + F.coalesce(F.try_element_at(offsets, F.lit(key)), F.lit(0.0))))
            for key in DESCRIPTOR_KEYS
        }
    )


def add_base_distance(averages: DataFrame) -> DataFrame:
    """RMS distance to the base over the nine descriptors and similarity 1 / (1 + distance)."""
    squares = [F.pow(F.coalesce(F.col(f"base_{k}"), F.lit(0.0)) - F.col(k), 2) for k in DESCRIPTOR_KEYS]
    distance = F.sqrt(mean_of(*squares))
    return averages.withColumns(
        {"descriptor_distance": r6(distance), "descriptor_similarity": r6(F.lit(1.0) / (F.lit(1.0) + distance))}
    )


def similarity_ranks(averages: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scale.row_numbers(averages, list(by or []), [F.col("descriptor_similarity").desc(), F.col("slug").asc()], "rank")


def _d(key: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(key), F.lit(default))


def _say(*parts) -> Column:
    return reduce(lambda a, b: F.concat(a, b), [F.lit(p) if isinstance(p, str) else p for p in parts])


def _if(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def ingredient_summaries() -> dict[str, Column]:
    """Five descriptor summaries; the phrases are fixed values."""
    lum, con, sat = _d("luminance"), _d("contrast"), _d("saturation")
    edge, sym, warm, upper = _d("edge_density"), _d("symmetry"), _d("warmth"), _d("upper_band_darkness")
    return {
        "overall": _say(
            _if(lum >= 0.7, "bright", "moderately bright"), ", ",
            _if(con < 0.1, "soft low-contrast", "clearer contrast"), ", ",
            _if(sym >= 0.95, "highly centered/symmetric", "moderately balanced"), " aggregate face impression",
        ),
        "face_parts": _say(
            _if(sym >= 0.95, "strong left-right balance", "less stable left-right balance"), " with ",
            _if(edge < 0.03, "soft facial and hairline edges", "crisper facial edges"),
            "; best treated as frontal and unobscured for generation",
        ),
        "color_tone": _say(
            _if(warm < 0, "slightly cool/neutral", "warm"), " palette with ",
            _if(sat < 0.1, "muted color", "moderate color"), " and bright skin/background values",
        ),
        "makeup_texture": _say(
            _if(con < 0.1, "natural, sheer-looking makeup", "more defined makeup"), "; ",
            _if(sat < 0.08, "low-color", "subtle visible color"), "; ",
            _if(edge < 0.03, "smooth texture", "more crisp detail texture"), "; avoid heavy contour or high-gloss extremes",
        ),
        "hair": _say(
            _if(upper >= 0.2, "dark natural hair signal", "lighter upper-band signal"), " with ",
            _if(edge < 0.03, "soft boundary", "defined boundary"), "; keep hair from covering eyes in generated candidates",
        ),
    }


# Descriptors shown as evidence of each summary.
INGREDIENT_EVIDENCE = {
    "overall": ["luminance", "contrast", "symmetry"],
    "face_parts": ["symmetry", "edge_density", "middle_luminance", "lower_luminance"],
    "color_tone": ["luminance", "warmth", "saturation"],
    "makeup_texture": ["contrast", "saturation", "edge_density"],
    "hair": ["upper_band_darkness", "edge_density", "warmth"],
}


def ingredients(descriptors: DataFrame, keys: list[str]) -> DataFrame:
    """Five rows per model: section, summary, and its evidence descriptors as a map."""
    sections = [
        F.struct(
            F.lit(section).alias("section"), text.alias("summary"),
            F.create_map(*[c for k in INGREDIENT_EVIDENCE[section] for c in (F.lit(k), r6(k))]).alias("evidence"),
        )
        for section, text in ingredient_summaries().items()
    ]
    return descriptors.select(*keys, F.explode(F.array(*sections)).alias("s")).select(*keys, "s.*")


def guidance() -> Column:
    """Guidance phrases as a list (fixed values)."""
    con, sat = _d("contrast"), _d("saturation")
    lines = F.array(
        _if(_d("luminance") >= 0.7, "bright portrait lighting", "moderate portrait lighting"),
        _if(con < 0.1, "low-contrast face rendering", "clearer facial contrast"),
        _if((con < 0.1) & (sat < 0.12), "natural clean makeup texture", "more defined makeup texture"),
        _if(
            _d("upper_band_darkness") >= 0.2, "dark natural hair kept away from both eyes",
            "lighter hair signal kept away from both eyes",
        ),
        _if(_d("edge_density") < 0.03, "soft hairline and facial contours", "defined hairline and facial contours"),
        _if(_d("symmetry") >= 0.95, "centered face with high left-right balance", "centered face with moderate left-right balance"),
        F.when(sat > 0.08, "subtle but visible color in lips and cheeks"),
        F.when(_d("warmth") < 0, "neutral to slightly cool color grade"),
    )
    return F.filter(lines, lambda x: x.isNotNull())


def trait_phrases() -> dict[str, Column]:
    """Tone, contrast, warmth, structure and texture phrases (fixed values, each with its own missing-key default)."""
    lum, con, edge = _d("luminance", 0.5), _d("contrast", 0.2), _d("edge_density", 0.08)
    warm, sat = _d("warmth", 0.0), _d("saturation", 0.15)
    sym, upper = _d("symmetry", 0.85), _d("upper_band_darkness", 0.4)
    balance = pick((warm > 0.05, "warm skin balance"), (warm < -0.04, "cool skin balance"), otherwise="neutral skin balance")
    depth = pick((sat < 0.08, "muted "), (sat > 0.22, "vivid "), otherwise="")
    return {
        "tone": pick((lum >= 0.62, "bright airy tones"), (lum <= 0.42, "deeper shaded tones"), otherwise="even mid-bright tones"),
        "contrast_phrase": pick(
            (con <= 0.16, "soft low contrast"), (con >= 0.28, "clear feature separation"), otherwise="moderate soft contrast"
        ),
        "warmth_phrase": F.concat(depth, balance),
        "structure": pick(
            ((sym > 0.9) & (upper > 0.45), "symmetric defined eyes"), (sym > 0.9, "symmetric gentle eyes"),
            (upper > 0.45, "defined eye shadow"), otherwise="balanced facial structure",
        ),
        "texture": pick((edge < 0.05, "smooth silhouette"), (edge > 0.12, "crisp hairline detail"), otherwise="soft readable hairline"),
    }
