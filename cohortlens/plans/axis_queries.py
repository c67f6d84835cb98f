"""Queries: descriptor axes, quality gate, data-quality audit."""

from pyspark.sql import functions as F

from ..functions import scale
from ..functions.numeric import r6, rescale
from ..operators import audit, axes, gates
from ..operators import scoring as sc
from . import inputs
from .registry import query

# Descriptors with gaps (contrast and symmetry are missing now and then) and an image size per item.
GAPPY = f"""SELECT item_id, run, luminance, CASE WHEN item_id % 9 = 0 THEN NULL ELSE contrast END AS contrast, warmth, saturation,
  edge_density, CASE WHEN item_id % 7 = 0 THEN NULL ELSE symmetry END AS symmetry, upper_band_darkness, middle_luminance, lower_luminance,
  200 + (item_id * 37) % 1500 AS width, 200 + (item_id * 53) % 1300 AS height FROM ({inputs.DESCRIPTORS})"""


def scale_sql(x, low, high):
    return f"greatest(-1e0, least(1e0, ({x} - {low}e0) / ({high}e0 - {low}e0) * 2e0 - 1e0))"


def axes_sql(source, keys):
    s = {n: scale_sql(f"coalesce({n}, {d}e0)", lo, hi) for n, (lo, hi, d) in axes.DESCRIPTOR_SCALES.items()}
    return f"""SELECT {keys}, round(({s['contrast']} + {s['edge_density']}) / 2, 6) AS soft_defined, round({s['warmth']}, 6) AS cool_warm,
      round(({s['luminance']} + {s['middle_luminance']} + {s['lower_luminance']}) / 3, 6) AS deep_bright,
      round(({s['contrast']} + {s['saturation']}) / 2, 6) AS natural_styled, round({s['saturation']}, 6) AS muted_vivid,
      round({s['edge_density']}, 6) AS soft_crisp, round({s['upper_band_darkness']}, 6) AS light_dark_hair, round({s['symmetry']}, 6) AS dynamic_symmetric FROM {source}"""


FLAGS_SQL = """list_filter([CASE WHEN deep_bright <= -0.55 THEN 'dark_or_underlit_image' END, CASE WHEN soft_defined >= 0.70 THEN 'high_contrast_or_heavy_definition' END,
  CASE WHEN soft_crisp >= 0.70 THEN 'high_texture_or_messy_edges' END, CASE WHEN dynamic_symmetric <= -0.45 THEN 'off_center_or_asymmetric_visibility' END,
  CASE WHEN light_dark_hair >= 0.75 AND deep_bright <= -0.20 THEN 'dark_upper_band_or_hair_shadow' END, CASE WHEN natural_styled >= 0.70 THEN 'strong_styling_or_makeup_signal' END], lambda f: f IS NOT NULL)"""
OUTLIER_SQL = "round((" + " + ".join(f"abs({a})" for a in axes.AXES) + ") / 8, 6)"


def distribution_sql(source):
    return f"""SELECT *, CASE WHEN quadrant_x >= 0 AND quadrant_y >= 0 THEN 'defined_bright' WHEN quadrant_y >= 0 THEN 'soft_bright' WHEN quadrant_x < 0 THEN 'soft_deep' ELSE 'defined_deep' END AS quadrant,
  CASE WHEN quadrant_x >= 0.33 AND quadrant_y >= 0.33 THEN 'defined_warm_bright_corner' WHEN quadrant_x <= -0.33 AND quadrant_y >= 0.33 THEN 'soft_clear_bright_corner'
    WHEN quadrant_x <= -0.33 AND quadrant_y <= -0.33 THEN 'soft_muted_deep_corner' WHEN quadrant_x >= 0.33 AND quadrant_y <= -0.33 THEN 'defined_cool_deep_corner' ELSE 'center_cross' END AS corner,
  CASE WHEN dynamic_symmetric >= 0 THEN 'symmetric' ELSE 'dynamic' END || '_' || CASE WHEN light_dark_hair >= 0 THEN 'dark_hair' ELSE 'light_hair' END AS cross_label,
  CASE WHEN len(found) = 0 THEN ['no_major_presentation_flags'] ELSE found END AS flags, {OUTLIER_SQL} AS outlier_score
  FROM (SELECT *, round((soft_defined + natural_styled) / 2, 6) AS quadrant_x, round((deep_bright + cool_warm) / 2, 6) AS quadrant_y, {FLAGS_SQL} AS found FROM {source})"""


AXIS_ROWS = f"""src AS ({GAPPY}), ax AS ({axes_sql('src', 'item_id, run, width, height')}), dist AS ({distribution_sql('ax')})"""
_COUNTS = ", ".join(axes.AXES)


def axis_rows(t):
    return axes.add_distribution(axes.add_axes(t.sql(GAPPY)))


@query("f1_rescale", f"SELECT l_orderkey, l_linenumber, round({scale_sql('l_extendedprice', 5000, 60000)}, 6) AS rescaled, 0e0 AS empty_interval FROM lineitem")
def f1(t):
    price = F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(rescale(price, 5000, 60000)).alias("rescaled"), rescale(price, 10, 10).alias("empty_interval"))


@query("f2_axis_vector", f"WITH {AXIS_ROWS} SELECT item_id, {_COUNTS} FROM ax")
def f2(t):
    """Through the map form: missing keys take their default, a non-number counts as 0."""
    df = t.sql(GAPPY)
    pairs = [F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(k).alias("value"))) for k in axes.DESCRIPTORS]
    maps = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))
    return axes.add_axes(axes.descriptor_columns(df.select("item_id", maps.alias("m")), "m")).select("item_id", *axes.AXES)


@query("f3_quadrant_corner_cross", f"WITH {AXIS_ROWS} SELECT item_id, quadrant_x, quadrant_y, quadrant, corner, cross_label FROM dist")
def f3(t):
    return axis_rows(t).select("item_id", "quadrant_x", "quadrant_y", "quadrant", "corner", "cross_label")


@query("f4_state_flags", f"WITH {AXIS_ROWS} SELECT item_id, array_to_string(flags, ';') AS flags FROM dist")
def f4(t):
    return axis_rows(t).select("item_id", F.array_join("presentation_flags", ";").alias("flags"))


@query("f5_outlier_score", f"WITH {AXIS_ROWS} SELECT item_id, outlier_score FROM dist")
def f5(t):
    return axis_rows(t).select("item_id", "outlier_score")


AXIS_MEANS = ", ".join(f"round(avg({a}), 6) AS {a}" for a in axes.AXES)


@query("f6_axis_summary", f"WITH {AXIS_ROWS}, m AS (SELECT run, count(*) AS item_count, {AXIS_MEANS} FROM dist GROUP BY run), d AS ({distribution_sql('m')}) SELECT run, item_count, {_COUNTS}, quadrant, corner, cross_label, outlier_score FROM d")
def f6(t):
    return axes.axis_summary(axis_rows(t), ["run"]).select("run", "item_count", *axes.AXES, "quadrant", "corner", "cross_label", "outlier_score")


@query("f6_quadrant_counts", f"WITH {AXIS_ROWS} SELECT run, quadrant, count(*) AS item_count FROM dist GROUP BY ALL")
def f6_quadrants(t):
    return axes.label_counts(axis_rows(t), ["run"], "quadrant")


@query("f6_cross_counts", f"WITH {AXIS_ROWS} SELECT run, cross_label, count(*) AS item_count FROM dist GROUP BY ALL")
def f6_crosses(t):
    return axes.label_counts(axis_rows(t), ["run"], "cross_label")


CONDITIONS = f"""{AXIS_ROWS}, cond AS (SELECT *, round(width / height, 6) AS aspect_ratio,
  CASE WHEN least(width, height) < 512 THEN 'small' WHEN least(width, height) < 1024 THEN 'medium' ELSE 'large' END AS resolution_bucket,
  CASE WHEN width / height < 0.85e0 THEN 'portrait' WHEN width / height > 1.15e0 THEN 'landscape' ELSE 'squareish' END AS aspect_bucket,
  CASE WHEN list_contains(flags, 'dark_or_underlit_image') THEN 'underlit' ELSE 'lighting_ok' END AS lighting,
  CASE WHEN list_contains(flags, 'off_center_or_asymmetric_visibility') THEN 'off_center' ELSE 'centered' END AS crop_quality FROM dist),
tagged AS (SELECT *, list_concat(['resolution:' || resolution_bucket, 'aspect:' || aspect_bucket, 'lighting:' || lighting, 'crop:' || crop_quality], list_transform(list_sort(flags), lambda f: 'presentation:' || f)) AS tags FROM cond)"""


def condition_rows(t):
    return axes.add_conditions(axis_rows(t))


@query("f7_condition_tags", f"WITH {CONDITIONS} SELECT item_id, aspect_ratio, resolution_bucket, aspect_bucket, lighting, crop_quality, array_to_string(tags, ';') AS condition_tags FROM tagged")
def f7(t):
    return condition_rows(t).select("item_id", "aspect_ratio", "resolution_bucket", "aspect_bucket", "lighting", "crop_quality", F.array_join("condition_tags", ";").alias("condition_tags"))


@query("f8_condition_strata", f"WITH {CONDITIONS}, e AS (SELECT unnest(tags) AS tag, * FROM tagged) SELECT tag, count(*) AS item_count, {AXIS_MEANS}, round(avg(outlier_score), 6) AS mean_outlier_score FROM e GROUP BY tag")
def f8(t):
    return axes.condition_strata(condition_rows(t))


@query("f9_axis_covariance", f"WITH {AXIS_ROWS} SELECT run, count(*) AS item_count, round(covar_pop(soft_defined, cool_warm), 6) AS defined_warm, round(var_pop(deep_bright), 6) AS bright_variance, round(covar_pop(soft_crisp, dynamic_symmetric), 6) AS crisp_symmetric FROM ax GROUP BY run")
def f9_covariance(t):
    cov = axes.axis_covariance(axis_rows(t), ["run"])
    at = lambda a, b: r6(F.get("covariances", F.lit(axes._PAIRS.index((axes.AXES.index(a), axes.AXES.index(b))))))
    return cov.select(
        "run", "item_count", at("soft_defined", "cool_warm").alias("defined_warm"), at("deep_bright", "deep_bright").alias("bright_variance"),
        at("soft_crisp", "dynamic_symmetric").alias("crisp_symmetric"),
    )


@query("f9_principal_axes")
def f9_axes(t):
    return axes.principal_axes(axis_rows(t), ["run"])


@query("f9_adaptive_projection")
def f9(t):
    return axes.adaptive_projection(axis_rows(t), ["run"])


@query("f10_flat_axis_table")
def f10(t):
    return axes.flat_axis_table(condition_rows(t), axes.adaptive_projection(axis_rows(t), ["run"]).drop("run"), ["item_id"])


# Detections: one box per line item on its order's image; orders without line items have no detection.
ORDER_ITEMS = "SELECT o_orderkey AS item_id, cast(480 + o_custkey % 400 AS bigint) AS width, cast(420 + o_orderkey % 300 AS bigint) AS height, o_orderpriority AS run FROM {orders}"
BOXES = "SELECT l_orderkey AS item_id, l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey AS box_id, cast(l_partkey % 500 AS bigint) AS x, cast(l_suppkey % 300 AS bigint) AS y, cast(40 + l_quantity * 8 AS bigint) AS w, cast(60 + (l_partkey % 7) * 50 AS bigint) AS h FROM {lineitem}"
GATE = f"""img AS ({ORDER_ITEMS}), box AS ({BOXES}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY w * h DESC, box_id) AS rn, count(*) OVER (PARTITION BY item_id) AS box_count FROM box),
big AS (SELECT item_id, box_count, x, y, w, h FROM ranked WHERE rn = 1),
judged AS (SELECT *, CASE WHEN box_count <> 1 THEN 'requires exactly one detected face' WHEN area_ratio IS NULL OR area_ratio < 0.08 THEN 'detected face is too small'
    WHEN area_ratio > 0.60 THEN 'detected face is too close or cropped' WHEN center_offset IS NULL OR center_offset > 0.24 THEN 'detected face is off center' ELSE 'single centered face' END AS reason
  FROM (SELECT img.item_id, img.run, coalesce(box_count, 0) AS box_count, w * h / (width * height) AS area_ratio,
    CASE WHEN x IS NOT NULL THEN greatest(abs(x + w / 2 - width / 2) / width, abs(y + h / 2 - height / 2) / height) END AS center_offset FROM img LEFT JOIN big USING (item_id)))"""


def gate_reviews(t):
    return gates.review_quality(t.sql(ORDER_ITEMS), t.sql(BOXES))


@query("c9_largest_box", f"WITH {GATE} SELECT * FROM big")
def c9(t):
    return gates.largest_boxes(t.sql(BOXES))


@query("c10_square_bounds", f"""WITH {GATE}, a AS (SELECT item_id, width, height, x, y, w, h, greatest(w, h) + 2 * cast(round_even(greatest(w, h) * 0.25e0, 0) AS bigint) AS side FROM big JOIN img USING (item_id)),
b AS (SELECT *, x + w // 2 - side // 2 AS l0, y + h // 2 - side // 2 AS t0 FROM a),
c AS (SELECT *, greatest(l0, 0) AS l1, greatest(l0, 0) + side AS r1, greatest(t0, 0) AS t1, greatest(t0, 0) + side AS b1 FROM b)
SELECT item_id, greatest(0, CASE WHEN r1 > width THEN l1 - (r1 - width) ELSE l1 END) AS left, greatest(0, CASE WHEN b1 > height THEN t1 - (b1 - height) ELSE t1 END) AS top, least(width, r1) AS right, least(height, b1) AS bottom FROM c""")
def c10(t):
    joined = gates.largest_boxes(t.sql(BOXES)).join(t.sql(ORDER_ITEMS), "item_id")
    return gates.square_bounds(joined).select("item_id", "left", "top", "right", "bottom")


@query("g1_box_geometry", f"WITH {GATE} SELECT item_id, round(area_ratio, 6) AS area_ratio, round(center_offset, 6) AS center_offset FROM judged")
def g1(t):
    return gate_reviews(t).select("item_id", r6("area_ratio").alias("area_ratio"), r6("center_offset").alias("center_offset"))


@query("g2_quality_gate", f"WITH {GATE} SELECT item_id, box_count, reason = 'single centered face' AS qa_pass, reason FROM judged")
def g2(t):
    return gate_reviews(t).select("item_id", "box_count", "qa_pass", "reason")


@query("g3_gate_summary", f"WITH {GATE} SELECT run, count(*) AS item_count, count(*) FILTER (reason = 'single centered face') AS pass_count, count(*) FILTER (reason <> 'single centered face') AS fail_count, round(count(*) FILTER (reason = 'single centered face') / count(*), 6) AS pass_rate FROM judged GROUP BY run")
def g3(t):
    return gates.gate_summary(gate_reviews(t), ["run"])


@query("g3_label_gate_summary", "SELECT toxic, count(*) AS item_count, count(*) FILTER (quality = 1) AS pass_count, count(*) FILTER (quality <> 1) AS fail_count, round(count(*) FILTER (quality = 1) / count(*), 6) AS pass_rate FROM labels GROUP BY toxic")
def g3_labels(t):
    return gates.gate_summary(t.labels, ["toxic"], F.col("quality") == 1)


# Documents as items: source is the subject; the roster also lists a source per nation, which may have no documents.
DOC_ROSTER = """SELECT DISTINCT lang, source AS subject FROM {documents} UNION SELECT CASE n_regionkey WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS lang,
  'src' || cast(n_nationkey AS string) AS subject FROM {nation}"""
ROSTER_SQL = f"roster AS ({DOC_ROSTER}), n AS (SELECT lang, source AS subject, count(*) AS n FROM documents GROUP BY ALL), per AS (SELECT lang, subject, coalesce(n, 0) AS n FROM roster LEFT JOIN n USING (lang, subject))"


def doc_roster(t):
    """The pairs of language and source seen, and the given ones."""
    return t.sql(DOC_ROSTER)


def docs(t):
    return t.documents.withColumn("subject", F.col("source"))


@query("g4_subject_balance", f"WITH {ROSTER_SQL} SELECT lang, count(*) AS subject_count, cast(sum(n) AS bigint) AS item_count, min(n) AS min_items, max(n) AS max_items, round(avg(n), 3) AS mean_items, round(max(n) / greatest(1, min(n)), 3) AS imbalance_ratio, count(*) FILTER (n = 0) AS empty_subjects FROM per GROUP BY lang")
def g4(t):
    return audit.subject_balance(doc_roster(t), docs(t), ["lang"])


DUPS = "dig AS (SELECT doc_id, lang, sha256(text) AS digest FROM documents), grp AS (SELECT digest, count(*) AS copies, min(doc_id) AS first_item FROM dig GROUP BY digest HAVING count(*) > 1)"


def digests(t):
    return audit.content_digests(t.documents, ["doc_id", "lang"], "text")


@query("g5_duplicate_groups", f"WITH {DUPS} SELECT * FROM grp")
def g5(t):
    return audit.duplicate_groups(digests(t), [], "doc_id")


@query("g5_duplicate_members", f"WITH {DUPS} SELECT digest, doc_id, copies, first_item FROM dig JOIN grp USING (digest)")
def g5_members(t):
    d = scale.settle(digests(t))
    return audit.duplicate_members(d, audit.duplicate_groups(d, [], "doc_id"), []).drop("lang")


@query("g5_duplicate_totals", f"WITH {DUPS} SELECT count(*) AS duplicate_group_count, cast(sum(copies) AS bigint) AS duplicate_item_count FROM grp")
def g5_totals(t):
    return audit.duplicate_totals(audit.duplicate_groups(digests(t), [], "doc_id"), [])


@query("g5_first_duplicate_groups", f"WITH {DUPS} SELECT * FROM grp ORDER BY digest LIMIT 25")
def g5_first(t):
    return audit.first_duplicate_groups(audit.duplicate_groups(digests(t), [], "doc_id"))


SIZED = f"SELECT i.run, i.path, CASE WHEN reason IS NULL THEN 200 + (item_id * 37) % 1500 END AS width, CASE WHEN reason IS NULL THEN 200 + (item_id * 53) % 1300 END AS height FROM ({inputs.ITEMS}) i"
SIZE_SQL = f"sized AS ({SIZED}), kinds AS (SELECT *, width IS NULL AS unreadable, least(width, height) < 384 AS small, (width / height < 0.55e0 OR width / height > 1.9e0) AS odd FROM sized)"


@query("g6_size_audit", f"WITH {SIZE_SQL} SELECT run, count(*) AS item_count, count(*) FILTER (unreadable) AS unreadable_count, count(*) FILTER (NOT unreadable AND small) AS small_count, count(*) FILTER (NOT unreadable AND odd) AS aspect_outlier_count, array_to_string((list(path ORDER BY path) FILTER (NOT unreadable AND small))[1:25], ';') AS small_sample, array_to_string((list(path ORDER BY path) FILTER (unreadable))[1:25], ';') AS unreadable_sample FROM kinds GROUP BY run")
def g6(t):
    df = audit.size_audit(t.sql(SIZED), ["run"])
    return df.select("run", "item_count", "unreadable_count", "small_count", "aspect_outlier_count", F.array_join("small_sample", ";").alias("small_sample"), F.array_join("unreadable_sample", ";").alias("unreadable_sample"))


# Audit metrics per language of the documents.
METRICS = """SELECT m.*, d.duplicate_group_count, u.hypothesis_count, cast(u.hypothesis_count AS bigint) AS unscored_count, cast(u.cohort_count AS bigint) AS cohort_count, cast(u.unique_quadrants AS bigint) AS unique_quadrants
FROM (SELECT lang, count(distinct source) AS subject_count, round(max(c) * 1e0 / min(c), 3) AS imbalance_ratio, sum(small) AS small_count, sum(odd) AS aspect_outlier_count, sum(bad) AS failed_count
  FROM (SELECT lang, source, count(*) AS c, count(CASE WHEN n_chars < 384 THEN 1 END) AS small, count(CASE WHEN n_chars > 20000 THEN 1 END) AS odd, count(CASE WHEN n_chars < 20 THEN 1 END) AS bad FROM {documents} GROUP BY lang, source) x GROUP BY lang) m
LEFT JOIN (SELECT lang, count(*) AS duplicate_group_count FROM (SELECT lang, text FROM {documents} GROUP BY lang, text HAVING count(*) > 1) y GROUP BY lang) d ON m.lang = d.lang
LEFT JOIN (SELECT lang, count(CASE WHEN q = 0 THEN 1 END) AS hypothesis_count, count(*) AS cohort_count, count(distinct q) AS unique_quadrants FROM (SELECT lang, source, max(CASE WHEN n_chars > 15000 THEN 1 ELSE 0 END) AS q FROM {documents} GROUP BY lang, source) z GROUP BY lang) u ON m.lang = u.lang"""
_RULES = [("subject_count < 50", "subject_count"), ("imbalance_ratio > 2", "imbalance_ratio"), ("coalesce(duplicate_group_count, 0) > 0", "duplicate_group_count"),
          ("small_count > 0", "small_count"), ("aspect_outlier_count > 0", "aspect_outlier_count"), ("failed_count > 0", "failed_count"),
          ("hypothesis_count > 0", "hypothesis_count"), ("unique_quadrants < 2 AND cohort_count > 1", "unique_quadrants"), ("unscored_count > 0", "unscored_count")]
ISSUE_SQL = f"m AS ({METRICS}), iss AS (" + " UNION ALL ".join(
    f"SELECT lang, '{code}' AS code, '{sev}' AS severity, '{item}' AS item, cast({value} AS double) AS evidence FROM m WHERE {cond}"
    for (code, sev, item), (cond, value) in zip(audit.ISSUES, _RULES)) + ")"


def issues(t):
    return audit.collect_issues(t.sql(METRICS), ["lang"])


@query("g8_issue_rules", f"WITH {ISSUE_SQL} SELECT lang, code, severity, item, evidence FROM iss")
def g8(t):
    return issues(t)


@query("g9_backlog", f"WITH {ISSUE_SQL} SELECT lang, item, code AS source_issue, severity FROM iss")
def g9(t):
    return audit.backlog(issues(t), ["lang"])


@query("g9_risk_level", f"WITH {ISSUE_SQL} SELECT m.lang, count(code) AS issue_count, count(*) FILTER (severity = 'blocking') AS blocking_count, count(*) FILTER (severity = 'warning') AS warning_count, count(*) FILTER (severity = 'info') AS info_count, CASE WHEN count(*) FILTER (severity = 'blocking') > 0 THEN 'needs_real_data_before_strong_claims' WHEN count(*) FILTER (severity = 'warning') > 0 THEN 'usable_with_caveats' ELSE 'clean' END AS risk_level FROM m LEFT JOIN iss USING (lang) GROUP BY m.lang")
def g9_risk(t):
    metrics = t.sql(METRICS)
    return audit.risk_levels(metrics, audit.collect_issues(metrics, ["lang"]), ["lang"])
