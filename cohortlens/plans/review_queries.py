"""Queries: run reviews, rubric, readiness, drift."""

from pyspark.sql import functions as F

from ..functions import scale
from ..functions.numeric import r6
from ..operators import drift, gates, readiness, rubric, runs
from ..operators import scoring as sc
from .axis_queries import GAPPY, axes_sql, axis_rows, distribution_sql
from .inputs import SCORED, cos, model
from .registry import query
from .score_queries import scored, style_scores

# Paths as the tools wrote them: relative to a run folder for one score file, absolute and unclean for the other.
REL = "CASE WHEN item_id % 3 = 0 THEN 'imgs/../out/Item_' ELSE '/Runs/' || run || '//out/./item_' END || cast(item_id AS string) || '.PNG'"
_ITEM = "'/out/item_' || cast(item_id AS string) || '.png'"
ELSEWHERE = f"'/elsewhere' || {_ITEM}"
CLEAN, EVALUATED, AT_WORK = f"'/runs/' || run || {_ITEM}", f"'/runs/' || run || '/evaluation' || {_ITEM}", f"'/work' || {_ITEM}"
BOTH = f"""{SCORED}, halves AS (SELECT item_id, run, path, v[33:64] AS v FROM items), hc AS ({model('halves')}),
sty AS (SELECT item_id, run, ({cos('v', 'mean_v')} + {cos('v', 'med_v')}) / 2 AS style_score FROM halves, hc),
a AS (SELECT item_id, run, {REL} AS path, {CLEAN} AS path_key, CASE WHEN item_id % 3 = 0 THEN {EVALUATED} ELSE {CLEAN} END AS shown, CASE WHEN item_id % 10 <> 9 THEN centroid_score END AS centroid_score FROM scored),
b AS (SELECT item_id + 1000000 AS item_id, run, CASE WHEN item_id % 8 = 7 THEN {ELSEWHERE} ELSE {CLEAN} END AS path_key, CASE WHEN item_id % 2 = 0 THEN {EVALUATED} WHEN item_id % 8 = 7 THEN {ELSEWHERE} ELSE {CLEAN} END AS shown, CASE WHEN run <> 'r3' THEN style_score END AS style_score FROM sty),
q AS (SELECT run, CASE WHEN item_id % 6 = 5 THEN {ELSEWHERE} ELSE {CLEAN} END AS path_key, CASE WHEN run <> 'r2' THEN item_id % 5 < 2 END AS qa_pass, CASE WHEN item_id % 5 < 2 THEN 'single centered face' ELSE 'detected face is off center' END AS reason FROM items)"""


def _bases():
    run = F.concat(F.lit("/runs/"), F.col("run"))
    return F.array(F.lit("/work"), F.concat(run, F.lit("/evaluation")), run)


def _rel(every=3):
    """Paths as sheets write them: one in ``every`` relative to one of the bases, the others absolute but not clean."""
    unclean = F.concat(F.lit("/Runs/"), F.col("run"), F.lit("//out/./item_"))
    return F.concat(F.when(F.col("item_id") % every == 0, "imgs/../out/Item_").otherwise(unclean), F.col("item_id"), F.lit(".PNG"))


def _elsewhere():
    return F.concat(F.lit("/Elsewhere//out/./item_"), F.col("item_id"), F.lit(".PNG"))


def score_rows(t):
    """Every item; one in ten could not be scored."""
    rows = scored(t).withColumns({"path": _rel(), "centroid_score": F.when(F.col("item_id") % 10 != 9, F.col("centroid_score"))})
    return runs.with_keys(rows.select("item_id", "run", "path", "centroid_score"), _bases())


def style_rows(t):
    """Style scores under other ids, so only the path can match them; one in eight lies elsewhere, and run r3 has none."""
    path = F.when(F.col("item_id") % 8 == 7, _elsewhere()).otherwise(_rel(2))
    rows = style_scores(t).withColumns({"path": path, "style_score": F.when(F.col("run") != "r3", F.col("style_score"))})
    shifted = rows.withColumn("item_id", F.col("item_id") + 1000000)
    return runs.with_keys(shifted.select("item_id", "run", "path", "style_score"), _bases())


def quality_rows(t):
    """Gate results; one in six lies elsewhere, and run r2 is undecided."""
    ok = F.when(F.col("run") != "r2", F.col("item_id") % 5 < 2)
    rows = t.sql("SELECT vec_id AS item_id, 'r' || cast(vec_id % 4 AS string) AS run FROM {embeddings}")
    rows = rows.withColumn("path", F.when(F.col("item_id") % 6 == 5, _elsewhere()).otherwise(_rel()))
    reason = F.when(F.col("item_id") % 5 < 2, "single centered face").otherwise("detected face is off center")
    return runs.with_keys(rows.withColumns({"qa_pass": ok, "reason": reason}), _bases())


@query("k2_path_keys", f"WITH {BOTH} SELECT item_id, path, path_key FROM a UNION ALL SELECT item_id, path, {EVALUATED} FROM a WHERE item_id % 3 = 0 UNION ALL SELECT item_id, path, {AT_WORK} FROM a WHERE item_id % 3 = 0")
def k2(t):
    return score_rows(t).select("item_id", "path", "path_key")


@query("k3_best_quality_score", f"WITH {BOTH}, p AS (SELECT a.* FROM a WHERE (run, path_key) IN (SELECT (run, path_key) FROM q WHERE qa_pass) AND centroid_score IS NOT NULL) SELECT run, arg_max(item_id, centroid_score) AS best_qa_item_id, arg_max(path, centroid_score) AS best_qa_path, round(max(centroid_score), 6) AS best_qa_score FROM p GROUP BY run")
def k3(t):
    return runs.best_quality(score_rows(t), quality_rows(t), ["run"]).withColumn("best_qa_score", r6("best_qa_score"))


COMBINED = f"{BOTH}, ab AS (SELECT a.*, (centroid_score + style_score) / 2 AS combined FROM a JOIN b USING (run, path_key) WHERE centroid_score + style_score IS NOT NULL)"


@query("k4_best_combined_score", f"WITH {COMBINED} SELECT run, arg_max(item_id, combined) AS best_combined_item_id, arg_max(path, combined) AS best_combined_path, round(max(combined), 6) AS best_combined_score FROM ab GROUP BY run")
def k4(t):
    return runs.best_combined(score_rows(t), style_rows(t), ["run"]).withColumn("best_combined_score", r6("best_combined_score"))


CANDIDATES = f"""{BOTH}, cand AS (SELECT run, coalesce(a.shown, b.shown) AS path_key, coalesce(a.item_id, b.item_id) AS item_id, centroid_score, style_score, (centroid_score + style_score) / 2 AS combined_score, qa_pass, q.reason AS qa_reason FROM a FULL JOIN b USING (run, path_key) LEFT JOIN q USING (run, path_key)),
tiered AS (SELECT *, CASE WHEN qa_pass AND centroid_score IS NOT NULL THEN 3 WHEN combined_score IS NOT NULL THEN 2 WHEN coalesce(centroid_score, style_score) IS NOT NULL THEN 1 ELSE 0 END AS tier,
  CASE WHEN qa_pass AND centroid_score IS NOT NULL THEN centroid_score WHEN combined_score IS NOT NULL THEN combined_score ELSE coalesce(centroid_score, style_score, 0) END AS tier_score FROM cand)"""


def candidates(t):
    return runs.candidate_table(score_rows(t), style_rows(t), quality_rows(t), ["run"])


@query("k5_candidate_table", f"WITH {CANDIDATES} SELECT run, path_key, item_id, round(centroid_score, 6) AS centroid_score, round(style_score, 6) AS style_score, round(combined_score, 6) AS combined_score, qa_pass, qa_reason FROM cand")
def k5(t):
    return candidates(t).drop("path").withColumns({c: r6(c) for c in ("centroid_score", "style_score", "combined_score")})


@query("k6_candidate_order", f"WITH {CANDIDATES} SELECT run, path_key, tier, row_number() OVER (PARTITION BY run ORDER BY tier DESC, tier_score DESC, path_key) AS position FROM tiered")
def k6(t):
    return runs.rank_candidates(candidates(t), ["run"]).select("run", "path_key", "tier", "position")


CONFIG = "SELECT 'r' || cast(n_nationkey AS string) AS run, 'local' AS provider, CASE WHEN n_nationkey = 3 THEN '' WHEN n_nationkey % 2 = 0 THEN 'mean' ELSE 'median' END AS centroid_kind, ' portrait  of ' || n_name || ' ' AS prompt, CASE WHEN n_nationkey = 1 THEN NULL ELSE 512 + n_nationkey END AS width, 640 AS height FROM {nation}"
REVIEWS = f"""{COMBINED}, cfg AS ({CONFIG}), qs AS (SELECT run, count(*) AS q_count, count(*) FILTER (qa_pass) AS pass_count FROM q GROUP BY run),
sums AS (SELECT run, count(centroid_score) AS item_count, count(*) - count(centroid_score) AS failed_count, arg_max(item_id, centroid_score) AS best_item_id, round(max(centroid_score), 6) AS best_centroid_score, round(avg(centroid_score), 6) AS mean_centroid_score FROM a GROUP BY run),
cs AS (SELECT run, arg_max(item_id, combined) AS best_combined_item_id, max(combined) AS best_combined_score FROM ab GROUP BY run),
bq AS (SELECT run, arg_max(item_id, centroid_score) AS best_qa_item_id, max(centroid_score) AS best_qa_score FROM a WHERE (run, path_key) IN (SELECT (run, path_key) FROM q WHERE qa_pass) GROUP BY run),
ss AS (SELECT run, round(max(style_score), 6) AS best_style_score FROM b GROUP BY run),
rv AS (SELECT s.*, cfg.* EXCLUDE (run), ss.best_style_score, qs.pass_count, cs.best_combined_item_id, cs.best_combined_score, bq.best_qa_item_id, bq.best_qa_score, len(regexp_split_to_array(trim(prompt), '\\s+')) AS prompt_words, coalesce(cast(width AS string) || 'x' || cast(height AS string), '') AS size
  FROM sums s LEFT JOIN cfg USING (run) LEFT JOIN ss USING (run) LEFT JOIN qs USING (run) LEFT JOIN cs USING (run) LEFT JOIN bq USING (run))"""


def run_reviews(t):
    scores, styles, quality = (scale.settle(rows) for rows in (score_rows(t), style_rows(t), quality_rows(t)))  # read by several parts
    style_best = styles.groupBy("run").agg(r6(F.max("style_score")).alias("best_style_score"))
    return runs.review_runs(
        t.sql(CONFIG), sc.score_summary(runs.smallest_key(scores), ["run"], tie="path_key"), style_best,
        gates.gate_summary(runs.smallest_key(quality), ["run"]).select("run", "pass_count"),
        runs.best_combined(scores, styles, ["run"]), runs.best_quality(scores, quality, ["run"]),
    )


@query("k1_run_review", f"WITH {REVIEWS} SELECT run, provider, centroid_kind, prompt_words, size, item_count, failed_count, best_item_id, best_centroid_score, mean_centroid_score, best_style_score, pass_count, best_combined_item_id, round(best_combined_score, 6) AS best_combined_score, best_qa_item_id, round(best_qa_score, 6) AS best_qa_score FROM rv")
def k1(t):
    rows = run_reviews(t).withColumns({c: r6(c) for c in ("best_combined_score", "best_qa_score")})
    return rows.select(
        "run", "provider", "centroid_kind", "prompt_words", "size", "item_count", "failed_count", "best_item_id", "best_centroid_score",
        "mean_centroid_score", "best_style_score", "pass_count", "best_combined_item_id", "best_combined_score", "best_qa_item_id", "best_qa_score",
    )


_TIER = "CASE WHEN best_qa_score IS NOT NULL THEN 2 WHEN coalesce(best_combined_score, best_centroid_score) IS NOT NULL THEN 1 ELSE 0 END"


@query("k6_run_order", f"WITH {REVIEWS} SELECT run, tier, row_number() OVER (ORDER BY tier DESC, coalesce(best_qa_score, best_combined_score, best_centroid_score, 0) DESC, run) AS position FROM (SELECT *, {_TIER} AS tier FROM rv)")
def k6_runs(t):
    return runs.rank_runs(run_reviews(t)).select("run", "tier", "position")


@query("k7_kind_rollup", f"WITH {REVIEWS}, k AS (SELECT *, coalesce(nullif(centroid_kind, ''), 'unknown') AS kind, {_TIER} AS tier, coalesce(best_qa_score, best_combined_score, best_centroid_score, 0) AS ts FROM rv), o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY tier DESC, ts DESC, run) AS rn FROM k) SELECT kind AS centroid_kind, count(*) AS run_count, max(run) FILTER (rn = 1) AS best_run, round(max(best_centroid_score), 6) AS best_centroid_score, round(max(best_qa_score), 6) AS best_qa_score, round(max(best_combined_score), 6) AS best_combined_score, arg_max(best_item_id, best_centroid_score) AS best_item_id, arg_max(best_qa_item_id, best_qa_score) AS best_qa_item_id, arg_max(best_combined_item_id, best_combined_score) AS best_combined_item_id, cast(sum(pass_count) AS bigint) AS qa_pass_count, cast(sum(item_count) AS bigint) AS item_count, cast(sum(failed_count) AS bigint) AS failed_count FROM o GROUP BY kind")
def k7(t):
    return runs.kind_rollup(run_reviews(t))


_PARTS = ["centroid_score", "cosine_to_mean", "euclidean_to_median"]


@query("r2_best_item_components", f"""WITH {SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY centroid_score DESC, path) AS rn, count(*) OVER (PARTITION BY run) AS n FROM scored),
ids AS (SELECT run, CASE run WHEN 'r0' THEN NULL WHEN 'r1' THEN max(item_id) FILTER (rn = 2) WHEN 'r2' THEN max(item_id) FILTER (rn = n) ELSE -1 END AS best_id FROM ranked GROUP BY run)
SELECT ids.run, best_id, path AS best_path, round(centroid_score, 6) AS best_centroid_score, round(cosine_to_mean, 6) AS best_cosine_to_mean, round(euclidean_to_median, 6) AS best_euclidean_to_median FROM ids LEFT JOIN ranked r ON r.run = ids.run AND (r.item_id = ids.best_id OR (ids.best_id IS NULL AND rn = 1))""")
def r2(t):
    """Runs whose best id is missing, in the top list, only in the full scores, or nowhere."""
    rows = scored(t)
    ends = rows.groupBy("run").agg(F.max_by("item_id", F.struct("centroid_score", "path")).alias("__top"),
                                   F.min_by("item_id", F.struct("centroid_score", "path")).alias("low"))
    top = sc.top_items(rows, ["run"])
    second = top.where("rank = 2").select("run", F.col("item_id").alias("second"))
    wanted = ends.join(second, "run").select(
        "run", F.lit(None).cast("bigint").alias("best_qa"), F.when(F.col("run") == "r1", F.col("second")).alias("run_best"),
        F.when(F.col("run") == "r2", F.col("low")).when(F.col("run") == "r0", None).when(F.col("run") == "r3", -1).alias("evaluation_best"),
    )
    found = runs.best_item_components(wanted, top, rows, ["best_qa", "run_best", "evaluation_best"], _PARTS)
    return found.select("run", "best_id", "best_path", *[r6(f"best_{p}").alias(f"best_{p}") for p in _PARTS])


BATCH = "cohort || '-' || run"
RUBRIC = f"""{SCORED}, gsrc AS ({GAPPY}), gax AS ({axes_sql('gsrc', 'item_id')}), dist AS ({distribution_sql('gax')}),
top AS (SELECT * FROM (SELECT {BATCH} AS batch, item_id, round(centroid_score * 2, 6) AS centroid_score, row_number() OVER (PARTITION BY {BATCH} ORDER BY centroid_score DESC, path) AS rank FROM scored) WHERE rank <= 5),
gate AS (SELECT CASE WHEN item_id % 14 = 0 THEN -1 - item_id ELSE item_id END AS item_id, CASE WHEN item_id % 7 <> 0 THEN item_id % 4 <> 0 END AS qa_pass FROM items), fl AS (SELECT CASE WHEN item_id % 18 = 0 THEN -1 - item_id ELSE item_id END AS item_id, CASE WHEN item_id % 9 <> 0 THEN flags END AS flags, true AS present FROM dist),
chk AS (SELECT top.*, top.centroid_score >= 0.35 AS score_pass, qa_pass, list_sort(list_intersect(flags, {rubric.SEVERE_FLAGS!r})) AS severe, present IS NOT NULL AS has_axes FROM top LEFT JOIN gate USING (item_id) LEFT JOIN fl USING (item_id)),
rec AS (SELECT *, list_filter([CASE WHEN NOT score_pass THEN 'centroid_score' END, CASE WHEN NOT qa_pass THEN 'quality' END, CASE WHEN has_axes AND len(severe) > 0 THEN 'presentation' END], lambda c: c IS NOT NULL) AS failed FROM chk),
cr AS (SELECT *, CASE WHEN len(failed) > 0 THEN 'reject' WHEN qa_pass IS NULL OR NOT has_axes THEN 'review' ELSE 'promote' END AS recommendation FROM rec),
bt AS (SELECT batch, CASE WHEN batch LIKE 'c0%' THEN NULL WHEN batch LIKE 'c1%' THEN 0.94e0 ELSE 0.95e0 + max(centroid_score) / 100 END AS p FROM top GROUP BY batch)"""


def batches(t):
    rows = scored(t).select(F.concat_ws("-", "cohort", "run").alias("batch"), "item_id", "path", (F.col("centroid_score") * 2).alias("centroid_score"))
    return sc.top_items(rows, ["batch"]).withColumn("centroid_score", r6("centroid_score"))


def null_batches(t):
    value = F.when(F.col("batch").startswith("c1"), 0.94).when(~F.col("batch").startswith("c0"), 0.95 + F.max("centroid_score") / 100)
    return rubric.batch_null_review(batches(t).groupBy("batch").agg(value.alias("best_percentile")))


def rubric_reviews(t):
    """Some candidates without a gate row or an axes row, some with an undecided gate or no flag list."""
    other = lambda every: F.when(F.col("item_id") % every == 0, -1 - F.col("item_id")).otherwise(F.col("item_id")).alias("item_id")
    quality = t.sql("SELECT vec_id AS item_id FROM {embeddings}").select(
        other(14), F.when(F.col("item_id") % 7 != 0, F.col("item_id") % 4 != 0).alias("qa_pass"), F.lit("detected face is off center").alias("reason"))
    flags = axis_rows(t).select(other(18), F.when(F.col("item_id") % 9 != 0, F.col("presentation_flags")).alias("presentation_flags"))
    return rubric.candidate_reviews(batches(t), quality, flags, ["item_id"])


@query("q1_batch_null_review", f"WITH {RUBRIC} SELECT batch, p IS NOT NULL AS null_available, p >= 0.95e0 AS null_pass, CASE WHEN p IS NULL THEN 'null calibration unavailable' WHEN p >= 0.95e0 THEN 'best centroid score clears null baseline' ELSE 'best centroid score is not sufficiently above null baseline' END AS null_reason FROM bt")
def q1(t):
    return null_batches(t).drop("best_percentile")


@query("q2_candidate_checks", f"WITH {RUBRIC} SELECT batch, item_id, rank, centroid_score, score_pass, qa_pass, CASE WHEN has_axes THEN coalesce(len(severe), 0) = 0 END AS presentation_pass, array_to_string(coalesce(severe, []), ';') AS severe_flags, array_to_string(failed, ';') AS failed_checks, recommendation FROM cr")
def q2(t):
    rows = rubric_reviews(t).withColumns({c: F.array_join(c, ";") for c in ("severe_flags", "failed_checks")})
    return rows.select("batch", "item_id", "rank", "centroid_score", "score_pass", "qa_pass", "presentation_pass", "severe_flags", "failed_checks", "recommendation")


@query("q3_pairwise_comparisons", f"WITH {RUBRIC} SELECT w.batch, w.item_id AS winner, l.item_id AS loser, round(w.centroid_score - l.centroid_score, 6) AS centroid_gap, CASE WHEN w.centroid_score - l.centroid_score >= 0.05e0 THEN 'clear_win' ELSE 'too_close' END AS decision FROM top w JOIN top l ON w.batch = l.batch AND w.rank < l.rank")
def q3(t):
    return rubric.pairwise_comparisons(batches(t), ["batch"])


@query("q4_batch_decision", f"WITH {RUBRIC} SELECT bt.batch, item_id, CASE WHEN p < 0.95e0 THEN 'review' ELSE recommendation END AS decision, CASE WHEN p < 0.95e0 THEN 'batch null calibration did not clear strict threshold' ELSE 'best candidate strict rubric result' END AS decision_reason FROM bt JOIN cr ON cr.batch = bt.batch AND rank = 1")
def q4(t):
    rows = rubric.batch_decisions(null_batches(t), rubric_reviews(t), ["batch"])
    return rows.select("batch", "item_id", "decision", "decision_reason")


EVIDENCE = "SELECT o_custkey AS model, o_orderkey % 13 AS position, o_orderstatus <> 'F' AS ready FROM {orders}"
_CHECK_ROWS = ", ".join(f"({i}, '{n}', {str(r).lower()}, '{a}')" for i, (n, r, a) in enumerate(readiness.CHECKS))


@query("r1_readiness", f"""WITH ev AS (SELECT model, position, bool_or(ready) AS ready FROM ({EVIDENCE}) GROUP BY ALL), checks(position, name, required, todo) AS (VALUES {_CHECK_ROWS}),
g AS (SELECT c_custkey AS model, checks.*, coalesce(ready, false) AS ready FROM customer, checks LEFT JOIN ev ON ev.model = c_custkey AND ev.position = checks.position)
SELECT model, count(*) FILTER (required AND ready) AS ready_count, count(*) FILTER (required) AS total_count, round(count(*) FILTER (required AND ready) / count(*) FILTER (required), 6) AS ready_ratio, count(*) FILTER (NOT required AND ready) AS optional_ready_count, count(*) FILTER (NOT required) AS optional_total_count,
  coalesce(string_agg(name, ';' ORDER BY position) FILTER (required AND NOT ready), '') AS missing, coalesce(string_agg(name, ';' ORDER BY position) FILTER (NOT required AND NOT ready), '') AS optional_missing, arg_min(todo, position) FILTER (required AND NOT ready) AS next_action FROM g GROUP BY model""")
def r1(t):
    names = F.array(*[F.lit(c[0]) for c in readiness.CHECKS])
    evidence = t.sql(EVIDENCE).select("model", F.get(names, F.col("position").cast("int")).alias("check"), "ready")
    rows = readiness.readiness(t.customer.select(F.col("c_custkey").alias("model")), evidence)
    return rows.withColumns({c: F.array_join(c, ";") for c in ("missing", "optional_missing")})


# Roster snapshots: each customer is a cohort; its last order date is when it was retrieved.
RETRIEVED = "SELECT o_custkey, max(o_orderdate) AS last_order FROM {orders} GROUP BY o_custkey"
CURRENT = f"""SELECT 'c' || cast(c_custkey AS string) AS slug, c_name || ' é\"x' AS name, CASE WHEN c_custkey % 19 = 0 THEN 'unknown' ELSE substring(cast(last_order AS string), 1, 10) || CASE WHEN c_custkey % 2 = 0 THEN 'T00:00:00Z' ELSE '' END END AS retrieved_at,
  'https://a.example/' || cast(c_custkey AS string) AS url_1, 'https://b.example/' || cast(c_nationkey AS string) AS url_2, c_mktsegment AS example_1, c_acctbal, c_mktsegment FROM {{customer}} LEFT JOIN ({RETRIEVED}) r ON o_custkey = c_custkey"""
_JSON = "sha256(to_json({{'name': name, 'public_examples': [example_1], 'retrieved_at': retrieved_at, 'slug': slug, 'source_urls': [{url}, url_2]}})::VARCHAR)"
SNAPSHOTS = f"""cur AS (SELECT *, {_JSON.format(url='url_1')} AS fp FROM ({CURRENT})),
prev AS (SELECT CASE WHEN c_acctbal >= 0 THEN slug ELSE 'old-' || slug END AS slug, {_JSON.format(url="CASE WHEN c_mktsegment = 'BUILDING' THEN 'https://old.example/' ELSE url_1 END")} AS fp0 FROM cur),
tasks AS (SELECT slug, CASE WHEN fp0 IS NULL THEN 'baseline_missing' ELSE 'source_fingerprint_changed' END AS reason, NULL::INTEGER AS age_days FROM cur LEFT JOIN prev USING (slug) WHERE fp0 IS NULL OR fp0 <> fp
  UNION ALL SELECT slug, 'retrieval_stale', age FROM (SELECT slug, date_diff('day', try_cast(substr(retrieved_at, 1, 10) AS date), date '1999-01-31') AS age FROM cur) WHERE age > 90)"""


def _roster(t, url):
    df = t.sql(CURRENT)
    return df.select("slug", "name", "retrieved_at", F.array(url, F.col("url_2")).alias("source_urls"), F.array("example_1").alias("public_examples"), "c_acctbal")


def current(t):
    return drift.snapshot(_roster(t, F.col("url_1")))


def previous(t):
    old = F.when(F.col("c_mktsegment") == "BUILDING", "https://old.example/").otherwise(F.col("url_1"))
    kept = F.col("c_acctbal") >= 0  # the others were known by another name
    return drift.snapshot(_roster(t, old)).withColumn("slug", F.when(kept, F.col("slug")).otherwise(F.concat(F.lit("old-"), "slug")))


def tasks(t):
    return drift.refresh_tasks(current(t), previous(t), F.to_date(F.lit("1999-01-31")))


@query("o1_fingerprint", f"WITH {SNAPSHOTS} SELECT slug, fp AS source_fingerprint FROM cur")
def o1(t):
    return current(t).select("slug", "source_fingerprint")


@query("o2_change_tasks", f"WITH {SNAPSHOTS} SELECT slug, reason FROM tasks WHERE reason <> 'retrieval_stale'")
def o2(t):
    return drift.change_tasks(current(t), previous(t)).select("slug", "reason")


@query("o3_refresh_tasks", f"WITH {SNAPSHOTS} SELECT slug, reason, age_days, CASE reason WHEN 'retrieval_stale' THEN 'Refresh source metadata; retrieved_at is ' || age_days || ' days old.' WHEN 'baseline_missing' THEN 'Create a baseline drift snapshot before reuse.' ELSE 'Refresh and re-review official roster evidence.' END AS action FROM tasks")
def o3(t):
    return tasks(t).select("slug", "reason", "age_days", "action")


@query("o4_task_summary", f"WITH {SNAPSHOTS} SELECT count(*) AS task_count, count(*) FILTER (reason = 'source_fingerprint_changed') AS changed_count, count(*) FILTER (reason = 'retrieval_stale') AS stale_count, count(*) FILTER (reason = 'baseline_missing') AS baseline_count FROM tasks")
def o4(t):
    return drift.task_summary(tasks(t))
