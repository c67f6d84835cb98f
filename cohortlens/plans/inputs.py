"""Input views the queries share, written in SQL both engines run, and SQL pieces the oracles share."""

from __future__ import annotations

# Items: every embedding row; label is the subject, cohort and run group the subjects and rows.
ITEMS = """SELECT vec_id AS item_id, 's' || cast(label AS string) AS subject, 'c' || cast(label % 3 AS string) AS cohort,
  'r' || cast(vec_id % 4 AS string) AS run,
  '/data/s' || cast(label AS string) || '/item_' || lpad(cast(vec_id AS string), 9, '0') || '.png' AS path,
  embedding, CASE WHEN embedding@1 > 0.25e0 THEN 'cannot identify item file' END AS reason
FROM {embeddings}"""

# The nine descriptors of every item, read off its first nine embedding values.
DESCRIPTORS = """SELECT vec_id AS item_id, 'r' || cast(vec_id % 4 AS string) AS run,
  0.55e0 + embedding@1 AS luminance, abs(embedding@2) AS contrast, embedding@3 / 2e0 AS warmth,
  abs(embedding@4) AS saturation, abs(embedding@5) / 2e0 AS edge_density, 0.9e0 + embedding@6 / 2e0 AS symmetry,
  abs(embedding@7) * 2e0 AS upper_band_darkness, 0.6e0 + embedding@8 AS middle_luminance,
  0.5e0 + embedding@9 AS lower_luminance
FROM {embeddings}"""

ITEM_ROWS = f"items AS (SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM ({ITEMS}))"


def unit(x: str) -> str:
    return f"CASE WHEN sqrt(list_inner_product({x},{x})) < 1e-12 THEN {x} ELSE list_transform({x}, lambda e: e / sqrt(list_inner_product({x},{x}))) END"


def digest(vector):
    """SQL for the text digest of a vector: sha256 over its values at six decimals."""
    return f"sha256(array_to_string(list_transform({vector}, lambda x: printf('%.6f', x)), ','))"


def cos(a: str, b: str) -> str:
    scale = f"(sqrt(list_inner_product({a},{a})) * sqrt(list_inner_product({b},{b})))"
    return f"CASE WHEN {scale} < 1e-12 THEN 0e0 ELSE list_inner_product({a},{b}) / {scale} END"


def positions(source: str, keys: str = "", v: str = "v") -> str:
    return f"SELECT {keys} unnest({v}) AS x, generate_subscripts({v}, 1) AS pos FROM {source}"


def model(source: str, keys: str = "", v: str = "v", normal: bool = True) -> str:
    """Mean and median vector per group, as mean_v and med_v."""
    wrap = unit if normal else (lambda x: x)
    return f"""SELECT {keys} {wrap('m')} AS mean_v, {wrap('d')} AS med_v FROM (
      SELECT {keys} list(m ORDER BY pos) AS m, list(d ORDER BY pos) AS d FROM (
        SELECT {keys} pos, avg(x) AS m, median(x) AS d FROM ({positions(source, keys, v)}) GROUP BY ALL) GROUP BY ALL)"""


def mean_only(source: str, keys: str, v: str = "v") -> str:
    return f"""SELECT {keys} {unit('m')} AS v FROM (SELECT {keys} list(m ORDER BY pos) AS m FROM (
      SELECT {keys} pos, avg(x) AS m FROM ({positions(source, keys, v)}) GROUP BY ALL) GROUP BY ALL)"""


SCORE_EXPR = f"""{cos('v', 'mean_v')} AS cosine_to_mean, {cos('v', 'med_v')} AS cosine_to_median,
  list_distance(v, mean_v) AS euclidean_to_mean, list_distance(v, med_v) AS euclidean_to_median"""

# Items scored against the centroid of all items.
SCORED = f"""{ITEM_ROWS}, cen AS ({model('items')}),
scored AS (SELECT *, (cosine_to_mean + cosine_to_median) / 2 AS centroid_score
  FROM (SELECT items.*, {SCORE_EXPR} FROM items, cen))"""

# The same with unreadable items kept as failed rows (null score).
SCORED_WITH_FAILED = f"""{ITEM_ROWS}, good AS (SELECT * FROM items WHERE reason IS NULL), cen AS ({model('good')}),
scored AS (SELECT item_id, subject, cohort, run, path, reason,
    CASE WHEN reason IS NULL THEN cosine_to_mean END AS cosine_to_mean,
    CASE WHEN reason IS NULL THEN cosine_to_median END AS cosine_to_median,
    CASE WHEN reason IS NULL THEN (cosine_to_mean + cosine_to_median) / 2 END AS centroid_score
  FROM (SELECT items.*, {SCORE_EXPR} FROM items, cen))"""
