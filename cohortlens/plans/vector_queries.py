"""Queries: vectors and centroids."""

from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..functions.numeric import r6
from ..operators import centroids as cen
from . import inputs
from .inputs import ITEM_ROWS, ITEMS, digest, mean_only, model, positions, unit
from .registry import Tables, query


def long_vector(df, keys, *vectors):
    """Vector columns as (keys, pos, one rounded value per vector); pos from 1."""
    zipped = df.select(*keys, F.posexplode(F.arrays_zip(*vectors)).alias("p", "e"))
    return zipped.select(*keys, (F.col("p") + 1).alias("pos"), *[r6(f"e.{v}").alias(v) for v in vectors])


def items(t: Tables):
    return t.sql(ITEMS)


def readable(t: Tables):
    return items(t).where(F.col("reason").isNull())


def unreadable_as_null(t: Tables):
    return items(t).withColumn("embedding", F.when(F.col("reason").isNull(), F.col("embedding")))


def roster(t: Tables):
    """One subject per nation key, so that some have no items."""
    return t.sql("SELECT 's' || cast(n_nationkey AS string) AS subject FROM {nation}")


def whole_roster(t: Tables):
    """The roster and every subject of the items, so that no item is left out."""
    return roster(t).union(items(t).select("subject")).distinct()


@query("d1_l2_normalise", f"WITH {ITEM_ROWS}, u AS (SELECT item_id, {unit('w')} AS v FROM (SELECT item_id, list_transform(v, lambda e: e * (item_id % 5)) AS w FROM items)) SELECT item_id, pos, round(x, 6) AS unit FROM ({positions('u', 'item_id,')})")
def d1(t):
    scaled = items(t).withColumn("w", F.transform(vec.as_vector("embedding"), lambda e: e * (F.col("item_id") % 5)))
    return long_vector(scaled.select("item_id", vec.l2_normalise("w").alias("unit")), ["item_id"], "unit")


@query("d2_mean_vector", f"WITH {ITEM_ROWS} SELECT subject, pos, round(avg(x), 6) AS mean_vector FROM ({positions('items', 'subject,')}) GROUP BY ALL")
def d2(t):
    return long_vector(cen.mean_vectors(items(t), ["subject"], "embedding", "mean_vector"), ["subject"], "mean_vector")


@query("d3_median_vector", f"WITH {ITEM_ROWS} SELECT subject, pos, round(median(x), 6) AS median_vector FROM ({positions('items', 'subject,')}) GROUP BY ALL")
def d3(t):
    return long_vector(cen.median_vectors(items(t), ["subject"], "embedding", "median_vector"), ["subject"], "median_vector")


MODEL_ROWS = "SELECT {keys} pos, round(a, 6) AS mean_embedding, round(b, 6) AS median_embedding FROM (SELECT {keys} unnest(mean_v) AS a, unnest(med_v) AS b, generate_subscripts(mean_v, 1) AS pos FROM cen)"


@query("d4_item_weighted_centroid", f"WITH {ITEM_ROWS}, cen AS ({model('items', 'run,')}) " + MODEL_ROWS.replace("{keys}", "run,"))
def d4(t):
    return long_vector(cen.centroid_models(items(t), ["run"]), ["run"], "mean_embedding", "median_embedding")


@query("d5_subject_balanced_centroid", f"WITH {ITEM_ROWS}, subj AS ({mean_only('items', 'subject,')}), cen AS ({model('subj')}) " + MODEL_ROWS.replace("{keys}", ""))
def d5(t):
    built = cen.centroid_models(items(t), mode="subject_balanced")
    return long_vector(built, [], "mean_embedding", "median_embedding")


@query("d5_subject_counts", f"WITH {ITEM_ROWS} SELECT cohort, subject, count(*) AS item_count FROM items GROUP BY ALL")
def d5_counts(t):
    return cen.subject_counts(items(t), ["cohort"])


SUBJECT_ROWS = f"""{ITEM_ROWS}, good AS (SELECT * FROM items WHERE reason IS NULL), cen AS ({model('good', 'subject,')}),
counts AS (SELECT subject, count(*) FILTER (reason IS NULL) AS n, count(*) FILTER (reason IS NOT NULL) AS f FROM items GROUP BY ALL),
sv AS (SELECT r.subject, CASE WHEN n > 0 THEN 'ok' WHEN f > 0 THEN 'failed' ELSE 'empty' END AS status,
  coalesce(n, 0) AS item_count, coalesce(f, 0) AS failed_count, len(mean_v) AS embedding_dim, mean_v, med_v
  FROM (SELECT 's' || cast(n_nationkey AS string) AS subject FROM nation) r LEFT JOIN counts USING (subject) LEFT JOIN cen USING (subject))"""


@query("d6_subject_vectors", f"WITH {SUBJECT_ROWS} SELECT subject, status, item_count, failed_count, embedding_dim, round(mean_v[1], 6) AS mean_1, round(med_v[64], 6) AS median_64, round(list_inner_product(mean_v, med_v), 6) AS mean_dot_median FROM sv")
def d6(t):
    built = cen.subject_vectors(roster(t), unreadable_as_null(t))
    return built.select(
        "subject", "status", "item_count", "failed_count", "embedding_dim",
        r6(F.get("mean_embedding", F.lit(0))).alias("mean_1"), r6(F.get("median_embedding", F.lit(63))).alias("median_64"),
        r6(vec.cosine("mean_embedding", "median_embedding")).alias("mean_dot_median"),
    )


@query("d7_subject_vector_manifest", f"WITH {SUBJECT_ROWS} SELECT count(*) AS subject_count, count(*) FILTER (status = 'ok') AS ok_count, count(*) FILTER (status = 'empty') AS empty_count, count(*) FILTER (status = 'failed') AS failed_count FROM sv")
def d7(t):
    return cen.subject_vector_manifest(cen.subject_vectors(roster(t), unreadable_as_null(t)))


ALL_SUBJECT_ROWS = SUBJECT_ROWS.replace("FROM nation) r", "FROM nation UNION SELECT subject FROM items) r")
for _side in ("counts", "cen"):  # items without a subject are a row as well
    ALL_SUBJECT_ROWS = ALL_SUBJECT_ROWS.replace(f"LEFT JOIN {_side} USING (subject)", f"LEFT JOIN {_side} ON r.subject IS NOT DISTINCT FROM {_side}.subject")


@query("d7_subject_manifest_rows", f"WITH {ALL_SUBJECT_ROWS} SELECT subject, status, item_count, failed_count, embedding_dim, round(sqrt(list_inner_product(mean_v, mean_v)), 6) AS mean_l2_norm, {digest('mean_v')} AS mean_digest, {digest('med_v')} AS median_digest FROM sv")
def d7_rows(t):
    return cen.subject_vector_rows(cen.subject_vectors(whole_roster(t), unreadable_as_null(t)))


@query("d8_cohort_centroid", f"WITH {ITEM_ROWS}, member AS ({mean_only('items', 'cohort, subject,')}), cen AS ({model('member', 'cohort,')}) " + MODEL_ROWS.replace("{keys}", "cohort,").replace("mean_embedding", "mean_centroid").replace("median_embedding", "median_centroid"))
def d8(t):
    members = cen.mean_vectors(items(t), ["cohort", "subject"], "embedding", "mean_embedding")
    members = members.withColumn("mean_embedding", vec.l2_normalise("mean_embedding"))
    return long_vector(cen.cohort_centroids(members, ["cohort"]), ["cohort"], "mean_centroid", "median_centroid")


@query("d9_vector_summary", f"""WITH {ITEM_ROWS} SELECT item_id, len(v) AS width, round(sqrt(list_inner_product(v, v)), 6) AS l2_norm,
  sha256(array_to_string(list_transform(v, lambda x: printf('%.6f', x)), ',')) AS digest,
  array_to_string(list_transform(v[1:8], lambda x: printf('%.6f', x)), ';') AS preview FROM items""")
def d9(t):
    summary = cen.vector_summary(items(t), ["item_id"], "embedding")
    preview = F.array_join(F.transform("preview", lambda x: F.format_string("%.6f", x)), ";")
    return summary.withColumn("preview", preview)


@query("d9_float32_digest")
def d9_bytes(t):
    return cen.vector_summary(items(t), ["item_id"], "embedding", exact_bytes=True).drop("preview")


PAIRS = f"""{ITEM_ROWS}, cen AS ({model('items', 'subject,')}),
p AS (SELECT item_id, v AS l, CASE WHEN item_id % 7 = 0 THEN NULL WHEN item_id % 11 = 0 THEN mean_v[1:32] ELSE mean_v END AS r FROM items JOIN cen USING (subject)),
d AS (SELECT *, list_transform(list_zip(l, r), lambda z: abs(z[1] - z[2])) AS ad FROM p WHERE len(l) = len(r))"""


@query("d10_pair_summary", f"""WITH {PAIRS} SELECT p.item_id, d.item_id IS NOT NULL AS available, CASE WHEN len(p.l) <> len(p.r) THEN 'shape mismatch' END AS error,
  round({inputs.cos('d.l', 'd.r')}, 6) AS cosine, round(list_distance(d.l, d.r), 6) AS euclidean, round(list_avg(ad), 6) AS mean_abs_delta, round(list_max(ad), 6) AS max_abs_delta
  FROM p LEFT JOIN d USING (item_id)""".replace("CASE WHEN (sqrt(list_inner_product(d.l,d.l))", "CASE WHEN d.l IS NULL THEN NULL WHEN (sqrt(list_inner_product(d.l,d.l))"))
def d10(t):
    means = cen.mean_vectors(items(t), ["subject"], "embedding", "m").withColumn("m", vec.l2_normalise("m"))
    sides = items(t).join(means, "subject").withColumn(
        "r", F.when(F.col("item_id") % 7 == 0, None).when(F.col("item_id") % 11 == 0, F.slice("m", 1, 32)).otherwise(F.col("m"))
    )
    return cen.pair_summary(sides, ["item_id"], "embedding", "r")


DESCRIPTOR_LONG = """SELECT run, item_id, name, value FROM (
  SELECT run, item_id, unnest([{names}]) AS name, unnest([{columns}]) AS value FROM ({src}))"""
_NAMES = ["luminance", "contrast", "warmth", "saturation", "edge_density", "symmetry"]
MEAN_MEDIAN = f"""long AS ({DESCRIPTOR_LONG.replace('{names}', ', '.join(repr(n) for n in _NAMES)).replace('{columns}', ', '.join(_NAMES)).replace('{src}', inputs.DESCRIPTORS)}),
sides AS (SELECT run, name, avg(value) FILTER (NOT (run = 'r1' AND name = 'contrast')) AS a, avg(value) FILTER (value > 0) AS b FROM long GROUP BY ALL)"""


def _sides(t):
    """Two descriptor maps per run: plain means (one run lacks a name) and means of the positive values."""
    df = t.sql(inputs.DESCRIPTORS)
    maps = F.create_map(*[c for n in _NAMES for c in (F.lit(n), F.col(n))])
    long = cen.map_rows(df.select("run", maps.alias("m")), ["run"], "m")
    left = long.where(~((F.col("run") == "r1") & (F.col("name") == "contrast"))).groupBy("run", "name").agg(F.avg("value").alias("value"))
    right = long.where("value > 0").groupBy("run", "name").agg(F.avg("value").alias("value"))
    return left, right


@query("d11_descriptor_delta", f"WITH {MEAN_MEDIAN} SELECT run, name, round(a - b, 6) AS delta FROM sides WHERE a - b IS NOT NULL")
def d11(t):
    return cen.descriptor_delta(*_sides(t), ["run"])


@query("d12_descriptor_delta_or_null", f"WITH {MEAN_MEDIAN} SELECT run, name, round(b - a, 6) AS delta FROM sides")
def d12(t):
    left, right = _sides(t)
    return cen.descriptor_delta(right, left, ["run"], keep_missing=True)


SHAPES = {"mean_embedding": [8, 8], "median_embedding": [4, 8, 2]}  # the vectors seen as grids
EXPORT = f"""{ITEM_ROWS}, cen AS ({model('items', 'cohort,')}),
vx AS (SELECT cohort, 'mean_embedding' AS vector, mean_v AS w FROM cen UNION ALL SELECT cohort, 'median_embedding', med_v FROM cen)"""


@query("a9_vector_export", f"WITH {EXPORT} SELECT cohort, vector, unnest(range(len(w))) AS index, round(unnest(w), 6) AS value, CASE vector WHEN 'mean_embedding' THEN '8x8' ELSE '4x8x2' END AS shape, 'float64' AS dtype, round(sqrt(list_inner_product(w, w)), 6) AS l2_norm, {digest('w')} AS digest FROM vx")
def a9(t):
    rows = cen.export_rows(cen.centroid_models(items(t), ["cohort"]), ["cohort"], ["mean_embedding", "median_embedding"], SHAPES)
    return rows.withColumn("value", r6("value"))


@query("a10_vector_export_read_back", f"WITH {EXPORT} SELECT cohort, vector, cast(len(w) AS bigint) AS values_count, round(sqrt(list_inner_product(w, w)), 6) AS l2_norm, CASE vector WHEN 'mean_embedding' THEN '8x8' ELSE '4x8x2' END AS dims FROM vx")
def a10(t):
    rows = cen.export_rows(cen.centroid_models(items(t), ["cohort"]), ["cohort"], ["mean_embedding", "median_embedding"], SHAPES)
    back = cen.read_back_export(rows, ["cohort"])
    return back.select("cohort", "vector", "values_count", "l2_norm", F.array_join(F.transform("dims", lambda x: x.cast("string")), "x").alias("dims"))
