"""Queries: bootstrap stability, null calibration, model audit, and item features on 8x8 grids made of the embeddings."""

from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..functions.numeric import r6
from ..operators import centroids as cen
from ..operators import pixels as px
from ..operators import resampling as rs
from .inputs import ITEM_ROWS, ITEMS, SCORED, cos, digest, mean_only, model, positions
from .registry import query
from .score_queries import scored
from .vector_queries import items, long_vector

RESAMPLES = 200
BITS = 3  # so that a few hundred units lie in several buckets


def _hash(*parts):
    return "('0x' || substr(md5(" + " || '|' || ".join(f"cast({p} AS string)" for p in parts) + "), 1, 13))::BIGINT"


def _word(resample, node, count, seed=0):
    """Select items that end in ``word``, 64 random bits of (resample, node, count)."""
    wrap = "18446744073709551616::UHUGEINT"
    total = " + ".join(f"{x}::UHUGEINT * {f}::UHUGEINT" for x, f in ((resample, 0x9FB21C651E98DF25), (node, 0xD6E8FEB86659FD93), (count, 0x9E3779B97F4A7C15), (seed, 0xA0761D6478BD642F)))
    return f"""({total}) % {wrap} AS w0, (xor(w0, w0 >> 30) * {0xBF58476D1CE4E5B9}::UHUGEINT) % {wrap} AS w1,
  (xor(w1, w1 >> 27) * {0x94D049BB133111EB}::UHUGEINT) % {wrap} AS w2, xor(w2, w2 >> 31) AS word"""


def stability_sql(units, keys, group):
    """Bootstrap over ``units`` (keys, unit, v): resampled cosines as ``cosines``.

    Draws are split over 2^BITS buckets level by level, each by a binomial found in its summed probabilities.
    """
    same = lambda a, b, *more: " AND ".join(f"{a}.{k} = {b}.{k}" for k in [*group, *more]) or "true"
    part = lambda *more: f"PARTITION BY {', '.join([*group, *more])}" if group or more else ""
    keyed = "".join(f"i.{k}, " for k in group)
    full_on = same("c", "f")
    levels = "".join(
        f"""s{x} AS (SELECT {keys} bucket >> {BITS - x} AS node, count_if((bucket >> {BITS - x - 1}) & 1 = 0)::BIGINT AS low, count(*) AS whole FROM ix GROUP BY ALL),
u{x} AS (SELECT i.*, s.low, s.whole, CASE WHEN low IN (0, whole) THEN 0.5e0 ELSE low / whole END AS p, {_word('i.rep', f'({2 ** x} + i.node)', 0)}, (word >> 11)::DOUBLE / {2 ** 53}e0 AS u FROM d{x} i JOIN s{x} s ON {same('i', 's', 'node')}),
k{x} AS (SELECT {keys} rep, node, m, low, whole, u, p, unnest(range(m + 1)) AS k FROM u{x}),
c{x} AS (SELECT *, sum(exp(lgamma(m + 1e0) - lgamma(k + 1e0) - lgamma(m - k + 1e0) + k * ln(p) + (m - k) * ln(1 - p))) OVER ({part('rep', 'node')} ORDER BY k) AS reached FROM k{x}),
t{x} AS (SELECT {keys} rep, node, m, CASE WHEN low = 0 THEN 0 WHEN low = whole THEN m ELSE count_if(reached < u)::BIGINT END AS taken FROM c{x} GROUP BY {keys} rep, node, m, low, whole),
d{x + 1} AS (SELECT {keys} rep, 2 * node AS node, taken AS m FROM t{x} UNION ALL SELECT {keys} rep, 2 * node + 1, m - taken FROM t{x}),
"""
        for x in range(BITS)
    )
    return f"""un AS (SELECT *, {_hash("'bucket'", 'unit')} >> {52 - BITS} AS bucket FROM ({units})),
ix AS (SELECT {keys} v, bucket, row_number() OVER ({part('bucket')} ORDER BY unit) - 1 AS ix, count(*) OVER ({part('bucket')}) AS nb, count(*) OVER ({part()}) AS n FROM un),
d0 AS (SELECT DISTINCT {keys} unnest(range({RESAMPLES})) AS rep, 0 AS node, n AS m FROM ix),
{levels}sz AS (SELECT DISTINCT {keys} bucket, nb FROM ix),
dr AS (SELECT {keyed} i.rep, i.node AS bucket, nb, unnest(range(m)) AS j FROM d{BITS} i JOIN sz ON {same('i', 'sz')} AND i.node = sz.bucket),
pk AS (SELECT *, {_word('rep', f'({2 ** BITS} + bucket)', 'j')} FROM dr),
wt AS (SELECT {keys} rep, bucket, (word >> 11)::BIGINT % nb AS ix, count(*) AS w FROM pk GROUP BY ALL),
wpos AS (SELECT {keyed} w.rep, i.n, w.w, unnest(i.v) AS x, generate_subscripts(i.v, 1) AS pos FROM ix i JOIN wt w ON {same('i', 'w', 'bucket', 'ix')}),
centre AS (SELECT {keys} rep, n, list(m ORDER BY pos) AS c FROM (SELECT {keys} rep, n, pos, sum(w * x) / sum(w) AS m FROM wpos GROUP BY ALL) GROUP BY ALL),
whole AS (SELECT {keys} list(m ORDER BY pos) AS f FROM (SELECT {keys} pos, avg(x) AS m FROM ({positions('ix', keys)}) GROUP BY ALL) GROUP BY ALL),
cosines AS (SELECT {''.join(f'c.{k}, ' for k in group)} n, {cos('c', 'f')} AS cosine FROM centre c JOIN whole f ON {full_on}),
stab AS (SELECT {keys} n AS unit_count, cast({RESAMPLES} AS bigint) AS resamples, round(avg(cosine), 6) AS self_cosine_mean, round(quantile_cont(cosine, 0.025), 6) AS self_cosine_low, round(quantile_cont(cosine, 0.975), 6) AS self_cosine_high, round(stddev_pop(cosine), 6) AS self_cosine_std, avg(cosine) AS m FROM cosines GROUP BY ALL)"""


BAND = "CASE WHEN m >= 0.99 THEN 'stable' WHEN m >= 0.95 THEN 'moderate' ELSE 'unstable' END"
_STAB = "unit_count, resamples, self_cosine_mean, self_cosine_low, self_cosine_high, self_cosine_std"


@query("d13_stability_by_run", f"WITH {ITEM_ROWS}, {stability_sql('SELECT run, cast(item_id AS string) AS unit, v FROM items', 'run,', ['run'])} SELECT run, 'item' AS unit, {_STAB}, {BAND} AS band FROM stab")
def d13(t):
    return rs.centroid_stability(items(t), ["run"], resamples=RESAMPLES, bits=BITS)


@query("d13_stability_of_subjects", f"WITH {ITEM_ROWS}, subj AS ({mean_only('items', 'subject,')}), {stability_sql('SELECT subject AS unit, v FROM subj', '', [])} SELECT 'subject' AS unit, {_STAB}, {BAND} AS band FROM stab")
def d13_subjects(t):
    return rs.centroid_stability(items(t), [], subject="subject", resamples=RESAMPLES, bits=BITS)


@query("d14_stability_band", f"WITH {ITEM_ROWS} SELECT item_id, CASE WHEN item_id % 5 < 2 THEN 'insufficient_units' WHEN 1 - abs(v[1]) / 4 >= 0.99 THEN 'stable' WHEN 1 - abs(v[1]) / 4 >= 0.95 THEN 'moderate' ELSE 'unstable' END AS band FROM items")
def d14(t):
    df = t.sql("SELECT vec_id AS item_id, 1e0 - abs(embedding@1) / 4e0 AS m, vec_id % 5 AS units FROM {embeddings}")
    return df.select("item_id", rs.stability_band(F.col("m"), F.col("units")).alias("band"))


AUDIT = f"{ITEM_ROWS}, cen AS ({model('items', 'cohort,')}), sizes AS (SELECT cohort, count(*) AS item_count FROM items GROUP BY ALL), {stability_sql('SELECT cohort, cast(item_id AS string) AS unit, v FROM items', 'cohort,', ['cohort'])}"


@query("d15_model_audit", f"WITH {AUDIT}, d AS (SELECT *, list_transform(list_zip(mean_v, med_v), lambda z: abs(z[1] - z[2])) AS ad FROM cen) SELECT d.cohort, item_count, len(mean_v) AS embedding_dim, round(sqrt(list_inner_product(mean_v, mean_v)), 6) AS mean_l2_norm, round(sqrt(list_inner_product(med_v, med_v)), 6) AS median_l2_norm, round({cos('mean_v', 'med_v')}, 6) AS mean_median_cosine, round(list_distance(mean_v, med_v), 6) AS mean_median_euclidean, round(list_avg(ad), 6) AS mean_median_mean_abs_delta, round(list_max(ad), 6) AS mean_median_max_abs_delta, {digest('mean_v')} AS mean_digest, {digest('med_v')} AS median_digest, unit_count, self_cosine_mean, {BAND} AS band FROM d JOIN sizes USING (cohort) JOIN stab USING (cohort)")
def d15(t):
    rows = items(t)
    return rs.model_audit(cen.centroid_models(rows, ["cohort"]), rs.centroid_stability(rows, ["cohort"], resamples=RESAMPLES, bits=BITS), ["cohort"])


NULLS = f"""{ITEM_ROWS}, cen AS ({model('items', 'cohort,')}), smp AS (SELECT unnest(range(4096)) AS sample), comp AS (SELECT sample, unnest(range(64)) AS k FROM smp),
ud AS (SELECT sample, k, {_word('sample', 'k', 0, 260623)}, (word >> 12)::DOUBLE / {2 ** 52}e0 AS u FROM comp), vd AS (SELECT sample, k, {_word('sample', 'k', 1, 260623)}, (word >> 12)::DOUBLE / {2 ** 52}e0 AS v FROM comp),
gauss AS (SELECT sample, list(sqrt(-2e0 * ln(u + 1e0 / {2 ** 52}e0)) * cos(2e0 * 3.141592653589793e0 * v) ORDER BY k) AS x FROM ud JOIN vd USING (sample, k) GROUP BY sample),
nul AS (SELECT cohort, sample, ({cos('x', 'mean_v')} + {cos('x', 'med_v')}) / 2 AS s FROM cen, gauss)"""


def nulls(t):
    return rs.null_distribution(cen.centroid_models(items(t), ["cohort"]), ["cohort"])


@query("e6_null_calibration", f"WITH {NULLS} SELECT cohort, count(*) AS sample_count, round(avg(s), 6) AS null_mean, round(stddev_pop(s), 6) AS null_std, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.9), 6) AS p90, round(quantile_cont(s, 0.95), 6) AS p95, round(quantile_cont(s, 0.99), 6) AS p99 FROM nul GROUP BY cohort")
def e6(t):
    return rs.null_summary(nulls(t), ["cohort"])


@query("e7_observed_percentiles", f"WITH {NULLS}, itm AS (SELECT items.cohort, ({cos('v', 'mean_v')} + {cos('v', 'med_v')}) / 2 AS score FROM items JOIN cen USING (cohort)), obs AS (SELECT cohort, avg(score) AS mean_score, median(score) AS median_score, max(score) AS best_score FROM itm GROUP BY cohort) SELECT nul.cohort, round(avg(CASE WHEN s <= best_score THEN 1 ELSE 0 END), 6) AS best_score_percentile, round(avg(CASE WHEN s <= mean_score THEN 1 ELSE 0 END), 6) AS mean_score_percentile, round(avg(CASE WHEN s <= median_score THEN 1 ELSE 0 END), 6) AS median_score_percentile FROM nul JOIN obs USING (cohort) GROUP BY nul.cohort")
def e7(t):
    from ..functions import scale
    from ..operators import scoring as sc

    rows = sc.score_items(items(t), cen.centroid_models(items(t), ["cohort"]), ["cohort"])
    observed = rows.groupBy("cohort").agg(F.avg("centroid_score").alias("mean_score"), F.max("centroid_score").alias("best_score"))
    observed = observed.join(scale.exact_median(rows, ["cohort"], "centroid_score", "median_score"), "cohort")
    return rs.observed_percentiles(nulls(t), observed, ["cohort"], ["best_score", "mean_score", "median_score"])


GRID = f"""{ITEM_ROWS}, g AS (SELECT item_id, subject, list_transform(v, lambda e: (e - list_min(v)) / (list_max(v) - list_min(v))) AS g FROM items),
px AS (SELECT item_id, subject, unnest(g) AS x, unnest(list_reverse(g)) AS b, generate_subscripts(g, 1) AS pos, g FROM g),
p AS (SELECT item_id, subject, x, x * 0.5e0 AS gr, b, pos, (pos - 1) // 8 AS r, (pos - 1) % 8 AS c, g FROM px)"""


def grid(t):
    """Grey 8x8 grid scaled to [0, 1]; red is the grid, green half of it, blue the grid turned around."""
    v = vec.as_vector("embedding")
    low, high = F.array_min("v"), F.array_max("v")
    spread = F.array_repeat(F.struct(low.alias("low"), (high - low).alias("span")), F.size("v"))
    rows = t.sql(ITEMS).select("item_id", "subject", v.alias("v")).withColumn("grey", F.zip_with("v", spread, lambda x, s: (x - s["low"]) / s["span"]))
    rgb = F.flatten(F.zip_with("grey", F.reverse("grey"), lambda x, b: F.array(x, x * 0.5, b)))
    return rows.drop("v").withColumn("rgb", rgb)


@query("c2_standardised_grid", f"WITH {GRID} SELECT item_id, pos, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS value FROM p WINDOW w AS (PARTITION BY item_id)")
def c2(t):
    return long_vector(grid(t).select("item_id", px.standardise("grey").alias("value")), ["item_id"], "value")


@query("c3_colour_histogram", f"""WITH {GRID}, ch AS (SELECT item_id, 0 AS channel, x AS val FROM p UNION ALL SELECT item_id, 1, gr FROM p UNION ALL SELECT item_id, 2, b FROM p),
h AS (SELECT item_id, channel, least(cast(floor(val * 8) AS integer), 7) AS bin, count(*) / 8e0 AS d FROM ch GROUP BY ALL), nrm AS (SELECT item_id, sqrt(sum(d * d)) AS n FROM h GROUP BY item_id),
slots AS (SELECT item_id, n, unnest(range(24)) AS s FROM nrm) SELECT slots.item_id, cast(s + 1 AS integer) AS pos, round(coalesce(d, 0) / n, 6) AS value FROM slots LEFT JOIN h ON h.item_id = slots.item_id AND channel = s // 8 AND bin = s % 8""")
def c3(t):
    return long_vector(grid(t).select("item_id", px.colour_histograms("rgb").alias("value")), ["item_id"], "value")


GRADIENT = f"""{GRID}, gr2 AS (SELECT item_id, pos, CASE WHEN c = 0 THEN g[pos + 1] - x WHEN c = 7 THEN x - g[pos - 1] ELSE (g[pos + 1] - g[pos - 1]) / 2 END AS gx,
  CASE WHEN r = 0 THEN g[pos + 8] - x WHEN r = 7 THEN x - g[pos - 8] ELSE (g[pos + 8] - g[pos - 8]) / 2 END AS gy FROM p), mag AS (SELECT *, sqrt(gx * gx + gy * gy) AS m, (atan2(gy, gx) + pi()) / (2 * pi()) AS a FROM gr2)"""


@query("c4_edge_features", f"""WITH {GRADIENT}, hist AS (SELECT item_id, least(cast(floor(a * 8) AS integer), 7) AS s, sum(m) AS d FROM mag GROUP BY ALL),
st AS (SELECT item_id, [avg(m), stddev_pop(m), quantile_cont(m, 0.75), quantile_cont(m, 0.9)] AS q FROM mag GROUP BY item_id),
f AS (SELECT item_id, s, d FROM hist UNION ALL SELECT item_id, unnest([8, 9, 10, 11]), unnest(q) FROM st), nrm AS (SELECT item_id, sqrt(sum(d * d)) AS n FROM f GROUP BY item_id), slots AS (SELECT item_id, n, unnest(range(12)) AS s FROM nrm)
SELECT slots.item_id, cast(slots.s + 1 AS integer) AS pos, round(coalesce(d, 0) / n, 6) AS value FROM slots LEFT JOIN f ON f.item_id = slots.item_id AND f.s = slots.s""")
def c4(t):
    return long_vector(grid(t).select("item_id", px.edges("grey").alias("value")), ["item_id"], "value")


_BANDS = ["r < 2", "r BETWEEN 2 AND 4", "r >= 5", "c < 4", "c >= 4"]
_REGIONS = ", ".join(f"avg(x) FILTER ({b}), stddev_pop(x) FILTER ({b})" for b in _BANDS) + ", avg(x), avg(gr), avg(b)"


@query("c5_region_features", f"WITH {GRID}, f AS (SELECT item_id, [{_REGIONS}] AS v FROM p GROUP BY item_id) SELECT item_id, cast(pos AS integer) AS pos, round(x, 6) AS value FROM ({positions('f', 'item_id,')})")
def c5(t):
    return long_vector(grid(t).select("item_id", px.regions("grey", "rgb").alias("value")), ["item_id"], "value")


_DESCRIBED = """avg(x) AS luminance, stddev_pop(x) AS contrast, avg({red}) - avg({blue}) AS warmth, avg(greatest({red}, {green}, {blue}) - least({red}, {green}, {blue})) AS saturation,
  1 - avg(abs(x - g[r * 8 + 8 - c])) FILTER (c < 4) AS symmetry, 1 - avg(x) FILTER (r BETWEEN 1 AND 2) AS upper_band_darkness, avg(x) FILTER (r BETWEEN 2 AND 4) AS middle_luminance, avg(x) FILTER (r >= 4) AS lower_luminance"""
_ROUNDED = ", ".join(f"round({d}, 6) AS {d}" for d in px.DESCRIPTORS)


@query("c7_descriptors", f"WITH {GRADIENT}, e AS (SELECT item_id, avg(m) AS edge_density FROM mag GROUP BY item_id), d AS (SELECT item_id, {_DESCRIBED.format(red='x', green='gr', blue='b')} FROM p GROUP BY item_id) SELECT item_id, {_ROUNDED} FROM d JOIN e USING (item_id)")
def c7(t):
    rows = grid(t).select("item_id", px.descriptors("grey", "rgb").alias("d"))
    return rows.select("item_id", *[r6(f"d.{d}").alias(d) for d in px.DESCRIPTORS])


AGGREGATE = f"""{GRID}, ag AS (SELECT subject, pos, r, c, least(1, greatest(0, avg(x) * 1.5e0)) AS red, least(1, greatest(0, avg(gr) * 1.5e0)) AS green, least(1, greatest(0, avg(b) * 1.5e0)) AS blue FROM p GROUP BY ALL),
gg AS (SELECT subject, list((red + green + blue) / 3 ORDER BY pos) AS g FROM ag GROUP BY subject), q AS (SELECT ag.*, (red + green + blue) / 3 AS x, g FROM ag JOIN gg USING (subject)),
ge AS (SELECT subject, avg(sqrt(gx * gx + gy * gy)) AS edge_density FROM (SELECT subject, CASE WHEN c = 0 THEN g[pos + 1] - x WHEN c = 7 THEN x - g[pos - 1] ELSE (g[pos + 1] - g[pos - 1]) / 2 END AS gx, CASE WHEN r = 0 THEN g[pos + 8] - x WHEN r = 7 THEN x - g[pos - 8] ELSE (g[pos + 8] - g[pos - 8]) / 2 END AS gy FROM q) GROUP BY subject)"""


@query("c8_appearance_descriptors", f"WITH {AGGREGATE}, d AS (SELECT subject, {_DESCRIBED.format(red='red', green='green', blue='blue')} FROM q GROUP BY subject) SELECT subject, {_ROUNDED} FROM d JOIN ge USING (subject)")
def c8(t):
    """Mean image of every subject, over-exposed so that clipping matters."""
    means = cen.mean_vectors(grid(t), ["subject"], "rgb", "m")
    rows = means.select("subject", px.appearance_descriptors(F.transform("m", lambda x: x * 1.5)).alias("d"))
    return rows.select("subject", *[r6(f"d.{d}").alias(d) for d in px.DESCRIPTORS])


def image_rows(t):
    """The grids as decoded 8-bit images (blue, green, red bytes); unreadable items have no pixels."""
    byte = lambda x: F.lpad(F.hex(F.floor(x * 255)), 2, "0")
    text = F.zip_with("grey", F.reverse("grey"), lambda x, b: F.concat(byte(b), byte(x * 0.5), byte(x)))
    side = F.lit(8)
    rows = grid(t).join(t.sql(ITEMS).select("item_id", "reason"), "item_id")
    return rows.select(
        "item_id", side.alias("width"), side.alias("height"), F.lit(3).alias("channels"),
        F.when(F.col("reason").isNull(), F.unhex(F.array_join(text, ""))).alias("bgr"), "reason",
    )


@query("c1_resized_appearance")
def c1(t):
    """Centre crop and resize to 64x64: mean of each item's appearance and its size."""
    rows = px.vectorise_items(image_rows(t), ["item_id"]).where(F.col("reason").isNull())
    mean = F.aggregate("appearance", F.lit(0.0), lambda s, x: s + x) / F.size("appearance")
    return rows.select("item_id", F.size("appearance").alias("values"), r6(mean).alias("mean_value"))


@query("c6_vectorised_items")
def c6(t):
    rows = px.vectorise_items(image_rows(t), ["item_id"])
    return rows.select("item_id", "reason", F.size("embedding").alias("width"), r6(vec.l2_norm("embedding")).alias("l2_norm"), *[r6(d).alias(d) for d in px.DESCRIPTORS])
