"""Queries: cohort parameters, fused scores, calibration.  Every customer is a cohort; its item has the same key."""

from pyspark.sql import functions as F

from ..functions import scale
from ..functions.numeric import r6
from ..operators import audit, axes, calibration, cohorts, fusion
from ..operators import scoring as sc
from . import inputs
from .axis_queries import FLAGS_SQL, GAPPY, axes_sql, axis_rows, distribution_sql
from .inputs import SCORED
from .registry import query
from .score_queries import scored

COHORTS = """SELECT c_custkey AS cohort_key, 'c' || cast(c_custkey AS string) AS slug, c_name AS name, c_mktsegment AS segment,
  (c_acctbal - 4000e0) / 40000e0 AS contrast_o, CASE WHEN c_nationkey % 5 = 0 THEN 0e0 ELSE c_acctbal / 100000e0 END AS saturation_o,
  c_nationkey / 100e0 - 0.12e0 AS warmth_o, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 0.05e0 - c_nationkey / 200e0 END AS symmetry_o FROM {customer}"""
OFFSET_KEYS = ["contrast", "saturation", "warmth", "symmetry"]


def raw_cohorts(t):
    """Cohort config with its offsets as a text map, an unknown key and non-numbers included."""
    df = t.sql(COHORTS)
    entries = [F.lit("glow"), F.lit("0.5")]
    for key in OFFSET_KEYS:
        entries += [F.lit(key), F.coalesce(F.col(f"{key}_o").cast("string"), F.lit("n/a"))]
    return df.select("cohort_key", "slug", "name", "segment", F.create_map(*entries).alias("descriptor_offsets"))


def cohort_config(t):
    return raw_cohorts(t).withColumn("offsets", cohorts.known_descriptors("descriptor_offsets")).drop("descriptor_offsets")


def base(t):
    return t.sql(inputs.DESCRIPTORS).agg(*[F.avg(k).alias(k) for k in cohorts.DESCRIPTOR_KEYS])


def averages(t):
    return cohorts.average_descriptors(cohort_config(t), base(t))


def _avg(key):
    low = "-1e0" if key == "warmth" else "0e0"
    offset = f" + coalesce({key}_o, 0e0)" if key in OFFSET_KEYS else ""
    return f"round(greatest({low}, least(1e0, base.{key}{offset})), 6) AS {key}"


_BASE = ", ".join(f"avg({k}) AS {k}" for k in cohorts.DESCRIPTOR_KEYS)
_SQUARES = " + ".join(f"(base.{k} - avgd.{k}) ^ 2" for k in cohorts.DESCRIPTOR_KEYS)
AVERAGES = f"""coh AS ({COHORTS}), base AS (SELECT {_BASE} FROM ({inputs.DESCRIPTORS})),
avgd AS (SELECT slug, name, segment, cohort_key, {', '.join(_avg(k) for k in cohorts.DESCRIPTOR_KEYS)} FROM coh, base),
dist0 AS (SELECT avgd.*, sqrt(({_SQUARES}) / 9) AS d FROM avgd, base), sim AS (SELECT *, round(d, 6) AS descriptor_distance, round(1 / (1 + d), 6) AS descriptor_similarity FROM dist0)"""


@query("h1_known_descriptors", f"WITH coh AS ({COHORTS}), l AS (SELECT slug, unnest({OFFSET_KEYS!r}) AS name, round(unnest([{', '.join(k + '_o' for k in OFFSET_KEYS)}]), 6) AS value FROM coh) SELECT slug, name, value FROM l WHERE value IS NOT NULL")
def h1(t):
    rows = cohort_config(t).select("slug", F.explode("offsets").alias("name", "value"))
    return rows.withColumn("value", r6("value"))


@query("h2_average_descriptors", f"WITH {AVERAGES} SELECT slug, {', '.join(cohorts.DESCRIPTOR_KEYS)} FROM avgd")
def h2(t):
    return averages(t).select("slug", *cohorts.DESCRIPTOR_KEYS)


@query("h3_similarity_rank", f"WITH {AVERAGES} SELECT slug, descriptor_distance, descriptor_similarity, row_number() OVER (ORDER BY descriptor_similarity DESC, slug) AS rank FROM sim")
def h3(t):
    return cohorts.similarity_ranks(cohorts.add_base_distance(averages(t))).select("slug", "descriptor_distance", "descriptor_similarity", "rank")


def _or(cond, yes, no):
    return f"CASE WHEN {cond} THEN '{yes}' ELSE '{no}' END"


_D = {k: f"coalesce({k}, 0e0)" for k in cohorts.DESCRIPTOR_KEYS}
SUMMARY_SQL = {
    "overall": _or(f"{_D['luminance']} >= 0.7", "bright", "moderately bright") + " || ', ' || " + _or(f"{_D['contrast']} < 0.1", "soft low-contrast", "clearer contrast") + " || ', ' || " + _or(f"{_D['symmetry']} >= 0.95", "highly centered/symmetric", "moderately balanced") + " || ' aggregate face impression'",
    "face_parts": _or(f"{_D['symmetry']} >= 0.95", "strong left-right balance", "less stable left-right balance") + " || ' with ' || " + _or(f"{_D['edge_density']} < 0.03", "soft facial and hairline edges", "crisper facial edges") + " || '; best treated as frontal and unobscured for generation'",
    "color_tone": _or(f"{_D['warmth']} < 0", "slightly cool/neutral", "warm") + " || ' palette with ' || " + _or(f"{_D['saturation']} < 0.1", "muted color", "moderate color") + " || ' and bright skin/background values'",
    "makeup_texture": _or(f"{_D['contrast']} < 0.1", "natural, sheer-looking makeup", "more defined makeup") + " || '; ' || " + _or(f"{_D['saturation']} < 0.08", "low-color", "subtle visible color") + " || '; ' || " + _or(f"{_D['edge_density']} < 0.03", "smooth texture", "more crisp detail texture") + " || '; avoid heavy contour or high-gloss extremes'",
    "hair": _or(f"{_D['upper_band_darkness']} >= 0.2", "dark natural hair signal", "lighter upper-band signal") + " || ' with ' || " + _or(f"{_D['edge_density']} < 0.03", "soft boundary", "defined boundary") + " || '; keep hair from covering eyes in generated candidates'",
}
GUIDANCE_SQL = f"""array_to_string(list_filter([{_or(_D['luminance'] + ' >= 0.7', 'bright portrait lighting', 'moderate portrait lighting')}, {_or(_D['contrast'] + ' < 0.1', 'low-contrast face rendering', 'clearer facial contrast')},
  {_or(_D['contrast'] + ' < 0.1 AND ' + _D['saturation'] + ' < 0.12', 'natural clean makeup texture', 'more defined makeup texture')},
  {_or(_D['upper_band_darkness'] + ' >= 0.2', 'dark natural hair kept away from both eyes', 'lighter hair signal kept away from both eyes')},
  {_or(_D['edge_density'] + ' < 0.03', 'soft hairline and facial contours', 'defined hairline and facial contours')}, {_or(_D['symmetry'] + ' >= 0.95', 'centered face with high left-right balance', 'centered face with moderate left-right balance')},
  CASE WHEN {_D['saturation']} > 0.08 THEN 'subtle but visible color in lips and cheeks' END, CASE WHEN {_D['warmth']} < 0 THEN 'neutral to slightly cool color grade' END], lambda g: g IS NOT NULL), ';')"""


@query("h4_ingredient_summaries", f"WITH src AS ({GAPPY}) " + " UNION ALL ".join(f"SELECT item_id, '{k}' AS section, {v} AS summary, {len(cohorts.INGREDIENT_EVIDENCE[k])} AS evidence_count, round({cohorts.INGREDIENT_EVIDENCE[k][0]}, 6) AS first_evidence FROM src" for k, v in SUMMARY_SQL.items()))
def h4(t):
    rows = cohorts.ingredients(t.sql(GAPPY), ["item_id"])
    first = F.create_map(*[F.lit(x) for k, v in cohorts.INGREDIENT_EVIDENCE.items() for x in (k, v[0])])
    return rows.select("item_id", "section", "summary", F.size("evidence").alias("evidence_count"), F.try_element_at("evidence", F.element_at(first, F.col("section"))).alias("first_evidence"))


@query("h4_guidance", f"WITH src AS ({GAPPY}) SELECT item_id, {GUIDANCE_SQL} AS guidance FROM src")
def h4_guidance(t):
    return t.sql(GAPPY).select("item_id", F.array_join(cohorts.guidance(), ";").alias("guidance"))


@query("h5_trait_phrases", f"""WITH src AS ({GAPPY}), d AS (SELECT item_id, luminance AS lum, coalesce(contrast, 0.2) AS con, edge_density AS edge, warmth AS warm, saturation AS sat, coalesce(symmetry, 0.85) AS sym, upper_band_darkness AS upp FROM src)
SELECT item_id, CASE WHEN lum >= 0.62 THEN 'bright airy tones' WHEN lum <= 0.42 THEN 'deeper shaded tones' ELSE 'even mid-bright tones' END AS tone,
  CASE WHEN con <= 0.16 THEN 'soft low contrast' WHEN con >= 0.28 THEN 'clear feature separation' ELSE 'moderate soft contrast' END AS contrast_phrase,
  CASE WHEN sat < 0.08 THEN 'muted ' WHEN sat > 0.22 THEN 'vivid ' ELSE '' END || CASE WHEN warm > 0.05 THEN 'warm skin balance' WHEN warm < -0.04 THEN 'cool skin balance' ELSE 'neutral skin balance' END AS warmth_phrase,
  CASE WHEN sym > 0.9 AND upp > 0.45 THEN 'symmetric defined eyes' WHEN sym > 0.9 THEN 'symmetric gentle eyes' WHEN upp > 0.45 THEN 'defined eye shadow' ELSE 'balanced facial structure' END AS structure,
  CASE WHEN edge < 0.05 THEN 'smooth silhouette' WHEN edge > 0.12 THEN 'crisp hairline detail' ELSE 'soft readable hairline' END AS texture FROM d""")
def h5(t):
    phrases = cohorts.trait_phrases()
    return t.sql(GAPPY).select("item_id", *[text.alias(name) for name, text in phrases.items()])


# Weights per line item: a negative, a missing and a plain one.
WEIGHTS = "SELECT l_orderkey, l_linenumber, l_partkey, l_discount - 0.03e0 AS w_descriptor_similarity, l_tax AS w_image_centroid_score, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_quantity / 50e0 END AS w_axis_alignment FROM {lineitem}"
_W = {k: f"greatest(coalesce(w_{k}, 0e0), 0e0)" for k in fusion.DEFAULT_WEIGHTS}
_TOTAL = f"({' + '.join(_W.values())})"


@query("i1_normalised_weights", f"SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'round({v} / CASE WHEN {_TOTAL} = 0 THEN 1e0 ELSE {_TOTAL} END, 6) AS w_{k}' for k, v in _W.items())} FROM ({WEIGHTS})")
def i1(t):
    return fusion.normalised_weights(t.sql(WEIGHTS))


HYP = ", ".join(f"h.{a} AS hyp_{a}" for a in axes.AXES)
OBS = ", ".join(f"o.{a} AS obs_{a}" for a in axes.AXES)
_GAPS = " + ".join(f"abs(hyp_{a} - obs_{a}) / 2" for a in axes.AXES)
_HAS = "list_contains(presentation_flags, '{}')"
ACTIONS_SQL = f"""list_filter([CASE WHEN image_centroid_score IS NULL THEN 'add_or_regenerate_named_sample' WHEN image_centroid_score < 0.1 THEN 'regenerate_with_detector_friendly_prompt' WHEN image_centroid_score < 0.25 THEN 'run_second_seed_and_compare' END,
  CASE WHEN axis_alignment < 0.55 THEN 'adjust_prompt_to_match_hypothesis_axes' END, CASE WHEN {_HAS.format('dark_or_underlit_image')} THEN 'increase_even_front_lighting' END,
  CASE WHEN {_HAS.format('off_center_or_asymmetric_visibility')} THEN 'enforce_centered_frontal_crop' END, CASE WHEN {_HAS.format('dark_upper_band_or_hair_shadow')} THEN 'reduce_hair_shadow_over_face' END,
  CASE WHEN {_HAS.format('high_texture_or_messy_edges')} THEN 'reduce_edge_noise_and_hair_flyaways' END], lambda a: a IS NOT NULL)"""
FUSED = f"""{AVERAGES}, {SCORED}, score_rows AS (SELECT 'c' || cast(item_id AS string) AS slug, round(centroid_score, 6) AS image_centroid_score FROM scored WHERE reason IS NULL),
hyp AS ({axes_sql('avgd', 'slug')}), gsrc AS ({GAPPY}), gax AS ({axes_sql('gsrc', 'item_id')}), obs AS (SELECT *, 'c' || cast(item_id AS string) AS oslug FROM ({distribution_sql('gax')})),
parts AS (SELECT s.slug, s.name, s.segment, s.cohort_key, s.contrast, s.descriptor_similarity, r.image_centroid_score, CASE WHEN r.image_centroid_score IS NULL THEN 0e0 ELSE round(greatest(0e0, least(1e0, (r.image_centroid_score + 1) / 2)), 6) END AS normalized_score,
  {HYP}, {OBS}, o.oslug IS NOT NULL AS has_axes, o.quadrant, coalesce(o.flags, ['missing_image']) AS presentation_flags
  FROM sim s JOIN hyp h USING (slug) LEFT JOIN score_rows r USING (slug) LEFT JOIN obs o ON o.oslug = s.slug),
aligned AS (SELECT *, CASE WHEN has_axes THEN round(greatest(0e0, least(1e0, 1 - ({_GAPS}) / 8)), 6) ELSE 0e0 END AS axis_alignment,
  CASE WHEN image_centroid_score IS NOT NULL AND has_axes THEN 'measured' WHEN image_centroid_score IS NOT NULL OR has_axes THEN 'partial' ELSE 'hypothesis_only' END AS confidence FROM parts),
acted AS (SELECT *, round(descriptor_similarity * 0.35e0 + normalized_score * 0.45e0 + axis_alignment * 0.2e0, 6) AS enhancement_score, {ACTIONS_SQL} AS found_actions FROM aligned),
fused AS (SELECT *, CASE WHEN len(found_actions) = 0 THEN ['keep_as_baseline_candidate'] ELSE found_actions END AS improvement_actions FROM acted)"""


def item_scores(t):
    rows = scored(t).where(F.col("reason").isNull())
    return rows.select(F.concat(F.lit("c"), "item_id").alias("slug"), r6("centroid_score").alias("image_centroid_score"))


def observed(t):
    names = [F.col(a).alias(f"obs_{a}") for a in axes.AXES]
    return axis_rows(t).select(F.concat(F.lit("c"), "item_id").alias("slug"), *names, "presentation_flags", "quadrant")


def hypothesis(t):
    df = cohorts.add_base_distance(averages(t)).withColumns({f"hyp_{a}": e for a, e in axes.axis_columns().items()})
    return df.select("cohort_key", "slug", "name", "offsets", "descriptor_similarity", *[f"hyp_{a}" for a in axes.AXES])


def fused(t):
    return fusion.fused_cohorts(hypothesis(t), item_scores(t), observed(t))


@query("i2_axis_alignment", f"WITH {FUSED} SELECT slug, axis_alignment FROM fused")
def i2(t):
    joined = hypothesis(t).join(observed(t), "slug", "left")
    return joined.select("slug", fusion.axis_alignment().alias("axis_alignment"))


@query("i3_unit_score", f"WITH {FUSED} SELECT slug, normalized_score FROM fused")
def i3(t):
    joined = cohort_config(t).join(item_scores(t), "slug", "left")
    return joined.select("slug", fusion.unit_score(F.col("image_centroid_score")).alias("normalized_score"))


@query("i4_fused_score", f"WITH {FUSED} SELECT slug, descriptor_similarity, image_centroid_score, normalized_score, axis_alignment, enhancement_score, confidence FROM fused")
def i4(t):
    return fused(t).select("slug", "descriptor_similarity", "image_centroid_score", "normalized_score", "axis_alignment", "enhancement_score", "confidence")


@query("i5_improvement_actions", f"WITH {FUSED} SELECT slug, array_to_string(improvement_actions, ';') AS actions FROM fused")
def i5(t):
    return fused(t).select("slug", F.array_join("improvement_actions", ";").alias("actions"))


@query("i6_fused_rank", f"WITH {FUSED} SELECT slug, enhancement_score, row_number() OVER (ORDER BY enhancement_score DESC, slug) AS rank FROM fused")
def i6(t):
    return fusion.fused_ranks(fused(t)).select("slug", "enhancement_score", "rank")


@query("i6_fused_summary", f"WITH {FUSED} SELECT count(*) AS cohort_count, count(*) FILTER (confidence = 'measured') AS measured_count, (SELECT slug FROM fused ORDER BY enhancement_score DESC, slug LIMIT 1) AS top_slug, max(enhancement_score) AS top_score FROM fused")
def i6_summary(t):
    return fusion.fused_summary(fused(t))


@query("i6_top_actions", f"WITH {FUSED}, a AS (SELECT unnest(improvement_actions) AS action FROM fused), c AS (SELECT action, count(*) AS uses FROM a GROUP BY action) SELECT * FROM (SELECT action, uses, row_number() OVER (ORDER BY uses DESC, action) AS position FROM c) WHERE position <= 5")
def i6_actions(t):
    return fusion.top_actions(fused(t))


@query("g7_cohort_evidence", f"WITH {FUSED}, rc AS (SELECT 'c' || cast(o_custkey AS string) AS slug, count(*) FILTER (o_totalprice > 300000) AS n FROM orders GROUP BY ALL), m AS (SELECT * FROM fused WHERE confidence = 'measured') SELECT f.slug, CASE WHEN f.slug = 'c0' THEN 'real_centroid_baseline' WHEN coalesce(n, 0) > 0 THEN 'real_and_generated' ELSE 'hypothesis_and_generated' END AS evidence_type, coalesce(n, 0) AS real_item_count, m.slug IS NOT NULL AS has_generated_score, m.enhancement_score, coalesce(m.quadrant, 'unmeasured') AS quadrant FROM fused f LEFT JOIN rc USING (slug) LEFT JOIN m USING (slug)")
def g7(t):
    return evidence(t)


def evidence(t, rows=None):
    real = t.orders.groupBy(F.concat(F.lit("c"), "o_custkey").alias("slug")).agg(F.count_if(F.col("o_totalprice") > 300000).alias("real_item_count"))
    measured = (fused(t) if rows is None else rows).where("confidence = 'measured'")
    return audit.cohort_evidence(cohort_config(t).select("slug"), real, measured, "c0")


@query("g7_evidence_totals", f"WITH {FUSED}, rc AS (SELECT 'c' || cast(o_custkey AS string) AS slug, count(*) FILTER (o_totalprice > 300000) AS n FROM orders GROUP BY ALL) SELECT count(*) AS cohort_count, count(*) FILTER (slug = 'c0') AS real_centroid_baseline, count(*) FILTER (slug <> 'c0' AND n > 0) AS real_and_generated, count(*) FILTER (slug <> 'c0' AND coalesce(n, 0) = 0) AS hypothesis_and_generated, count(*) FILTER (confidence <> 'measured') AS unscored_count, count(DISTINCT quadrant) FILTER (confidence = 'measured') AS unique_quadrants FROM fused LEFT JOIN rc USING (slug)")
def g7_totals(t):
    return audit.evidence_totals(evidence(t))


def _gap_sql(key, target):
    return f"round(CASE WHEN {key} IS NULL THEN {target}e0 ELSE greatest(0e0, {target}e0 - {key}) END, 6) AS gap_{key}"


GAPS = f"""{FUSED}, gaps AS (SELECT *, {', '.join(_gap_sql(k, v) for k, v in calibration.TARGETS.items())}, row_number() OVER (ORDER BY enhancement_score DESC, slug) AS rank FROM fused),
cal AS (SELECT *, CASE WHEN gap_image_centroid_score >= 0.25 THEN 'regenerate' WHEN gap_axis_alignment >= 0.20 THEN 'axis_calibration' WHEN gap_enhancement_score >= 0.08 THEN 'seed_sweep' ELSE 'baseline_control' END AS priority,
  CASE WHEN greatest(gap_image_centroid_score, gap_axis_alignment, gap_enhancement_score) >= 0.30 THEN 'high' WHEN greatest(gap_image_centroid_score, gap_axis_alignment, gap_enhancement_score) >= 0.15 THEN 'medium' ELSE 'low' END AS intensity FROM gaps)"""


@query("j1_gaps", f"WITH {GAPS} SELECT slug, gap_image_centroid_score, gap_axis_alignment, gap_enhancement_score FROM cal")
def j1(t):
    return calibration.add_gaps(fused(t)).select("slug", *[f"gap_{k}" for k in calibration.TARGETS])


@query("j2_priority_intensity", f"WITH {GAPS} SELECT slug, priority, intensity FROM cal")
def j2(t):
    return calibration.add_gaps(fused(t)).select("slug", "priority", "intensity")


_DELTAS = f"""dl AS (SELECT slug, cohort_key, has_axes, unnest({axes.AXES!r}) AS axis, unnest([{', '.join(f'hyp_{a}' for a in axes.AXES)}]) AS e, unnest([{', '.join(f'obs_{a}' for a in axes.AXES)}]) AS o FROM fused),
dd AS (SELECT *, round(coalesce(e, 0e0) - coalesce(o, 0e0), 6) AS axis_delta FROM dl)"""


@query("j3_axis_delta", f"WITH {FUSED}, {_DELTAS} SELECT slug, axis, axis_delta FROM dd")
def j3(t):
    return calibration.axis_delta_rows(fused(t), ["slug"]).select("slug", "axis", "axis_delta")


_RULE_ROWS = ", ".join(f"('{a}', '{lo}', '{hi}', {src!r}, {i})" for i, (a, lo, hi, src) in enumerate(calibration.AXIS_RULES))
_SOURCES = f"""rules(axis, low, high, sources, ord) AS (VALUES {_RULE_ROWS}),
off AS (SELECT slug, unnest({OFFSET_KEYS!r}) AS name, unnest([{', '.join(k + '_o' for k in OFFSET_KEYS)}]) AS value FROM coh),
used AS (SELECT slug, axis, count(*) AS offset_count, round(sum(round(value, 6)), 6) AS offset_sum FROM off, rules WHERE list_contains(sources, name) AND value IS NOT NULL AND value <> 0 GROUP BY ALL)"""


@query("j4_attribution", f"WITH {FUSED}, {_DELTAS}, {_SOURCES} SELECT dd.slug, axis, axis_delta, CASE WHEN axis_delta > 0 THEN high ELSE low END AS clause, coalesce(offset_count, 0) AS offset_count, coalesce(offset_sum, 0) AS offset_sum, round(e, 6) AS hypothesis_axis, round(o, 6) AS observed_axis FROM dd JOIN rules USING (axis) LEFT JOIN used USING (slug, axis) WHERE abs(axis_delta) >= 0.25 OR offset_count > 0")
def j4(t):
    rows = calibration.attribution_rows(fused(t), ["slug"])
    values = F.map_values("descriptor_delta")
    return rows.select(
        "slug", "axis", "axis_delta", "clause", F.size("descriptor_delta").cast("bigint").alias("offset_count"),
        r6(F.aggregate(values, F.lit(0.0), lambda s, x: s + x)).alias("offset_sum"), "hypothesis_axis", "observed_axis",
    )


_NOTES = ", ".join(f"'{k}': '{v}'" for k, v in calibration.ACTION_NOTES.items())


@query("j5_axis_notes", f"""WITH {FUSED}, {_DELTAS}, {_SOURCES}, n AS (SELECT slug, string_agg(CASE WHEN coalesce(e, 0e0) - coalesce(o, 0e0) > 0 THEN high ELSE low END, ';' ORDER BY ord) FILTER (abs(coalesce(e, 0e0) - coalesce(o, 0e0)) >= 0.25) AS notes, bool_or(has_axes) AS has_axes FROM dd JOIN rules USING (axis) GROUP BY slug)
SELECT slug, CASE WHEN NOT has_axes THEN 'collect a measured image sample for this agency' ELSE coalesce(notes, 'keep current visual axis balance') END AS notes FROM n""")
def j5(t):
    return fused(t).select("slug", F.array_join(calibration.axis_notes(), ";").alias("notes"))


@query("j5_action_notes", f"WITH {FUSED}, book AS (SELECT MAP {{{{{_NOTES}}}}} AS b) SELECT slug, array_to_string(list_transform(improvement_actions, lambda a: coalesce(b[a], a)), ';') AS notes FROM fused, book".replace("{{", "{").replace("}}", "}"))
def j5_actions(t):
    return fused(t).select("slug", F.array_join(calibration.action_notes(), ";").alias("notes"))


def calibrated(t):
    return fusion.fused_ranks(calibration.add_gaps(fused(t)))


@query("j6_seed_plan", f"WITH {GAPS} SELECT slug, priority, 260623 + (rank - 1) * 3 AS seed FROM cal")
def j6(t):
    return calibration.seed_plan(calibrated(t)).select("slug", "priority", "seed")


@query("j6_calibration_summary", f"WITH {GAPS} SELECT count(*) AS cohort_count, count(*) FILTER (priority = 'regenerate') AS regenerate, count(*) FILTER (priority = 'axis_calibration') AS axis_calibration, count(*) FILTER (priority = 'seed_sweep') AS seed_sweep, count(*) FILTER (priority = 'baseline_control') AS baseline_control FROM cal")
def j6_summary(t):
    return calibration.calibration_summary(calibration.add_gaps(fused(t)))


@query("j6_regenerate_first", f"WITH {GAPS} SELECT slug, rank FROM cal WHERE priority IN ('regenerate', 'axis_calibration')")
def j6_first(t):
    return calibration.regenerate_first(calibrated(t)).select("slug", "rank")


@query("j7_cohort_pages", f"""WITH {GAPS}, ev AS (SELECT CASE WHEN n > 0 THEN slug ELSE 'old-' || slug END AS slug, CASE WHEN slug = 'c0' THEN 'real_centroid_baseline' ELSE 'real_and_generated' END AS evidence_type, n AS real_item_count FROM (SELECT 'c' || cast(o_custkey AS string) AS slug, count(*) FILTER (o_totalprice > 300000) AS n FROM orders GROUP BY ALL))
SELECT c.slug, c.enhancement_score, c.confidence, c.segment, c.contrast AS average_contrast, c.priority, coalesce(ev.evidence_type, 'unverified') AS evidence_type, coalesce(ev.real_item_count, 0) AS real_item_count, 'unknown' AS quality_risk, 'assets/' || c.slug || '.png' AS image FROM cal c LEFT JOIN ev USING (slug)""")
def j7(t):
    rows = scale.settle(fused(t))
    named = F.when(F.col("real_item_count") > 0, F.col("slug")).otherwise(F.concat(F.lit("old-"), "slug"))  # the others have none
    pages = fusion.cohort_pages(
        rows.select("slug", "enhancement_score", "confidence"),
        cohort_config(t).select("slug", "segment"),
        averages(t).select("slug", F.col("contrast").alias("average_contrast")),
        calibration.add_gaps(rows).select("slug", "priority"),
        evidence(t, rows).select(named.alias("slug"), "evidence_type", "real_item_count"),
    )
    return pages
