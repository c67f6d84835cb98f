"""Queries: pages, manifests and files."""

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import centroids as cen
from ..operators import engagement as eng
from ..operators import scoring as sc
from ..sources import files, pages
from .engagement_queries import CENTS, ENG, engagement, handle_roster
from .inputs import ITEM_ROWS, SCORED, model
from .registry import query
from .score_queries import scored
from .vector_queries import items, long_vector

# The stored pages with profile markup put into their heads (the tables' pages have none).
RICH = """SELECT page_id, url, replace(html, '<head>', '<head>' || CASE WHEN page_id % 2 = 0 THEN '<meta property="og:title" content="Name ' || cast(page_id AS string) || ' &amp; Co | Site">' ELSE '' END
  || CASE WHEN page_id % 3 = 0 THEN '<meta name="description" content="1990年1月1日"><meta name="description" content="born ' || cast(1980 + page_id % 35 AS string) || '年' || cast(1 + page_id % 12 AS string) || '月 ' || cast(1 + page_id % 28 AS string) || '日">' ELSE '' END
  || CASE WHEN page_id % 3 = 1 THEN '<meta property="og:description" content="2001年' || cast(1 + page_id % 12 AS string) || '月5日">' ELSE '' END
  || '<meta property="og:image" content="/wp-content/uploads/p' || cast(page_id % 90 AS string) || '.jpg"><img alt="a b" src="/wp-content/uploads/logo.png" srcset="/wp-content/uploads/x' || cast(page_id % 50 AS string) || '.png 1x, /big.png 2x"><img src="https://cdn.example/wp-content/uploads/shared.webp?w=2"><a href="/wp-content/uploads/p' || cast(page_id % 90 AS string) || '.jpg">') AS html FROM {pages}"""
HOST = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"


@query("b1_site_links", f"WITH l AS (SELECT page_id, {HOST} AS host, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) - 1 AS pos FROM pages), n AS (SELECT page_id, pos, host || regexp_replace(replace(href, '&amp;', '&'), '/+$', '') || '/' AS link FROM l) SELECT page_id, link, cast(min(pos) AS integer) AS pos FROM n WHERE NOT regexp_matches(link, '^https?://[^/]*/$') GROUP BY ALL")
def b1(t):
    return pages.site_links(t.pages, ["page_id"], "/")


_AMP = "replace(regexp_replace(replace({}, '&quot;', '\"'), '&amp;?', '&', 'g'), '&middot;', '·')"


@query("b2_page_names", f"WITH r AS ({RICH}) SELECT page_id, nullif(trim(split_part({_AMP.format('''coalesce(nullif(regexp_extract(html, 'property=\"og:title\" content=\"([^\"]*)\"', 1), ''), regexp_extract(html, '(?s)<title>(.*?)</title>', 1))''')}, '|', 1)), '') AS name FROM r")
def b2(t):
    return pages.profiles(t.sql(RICH), ["page_id"]).select("page_id", "name")


@query("b3_meta_map", f"""WITH r AS ({RICH}), m AS (SELECT page_id, unnest(regexp_extract_all(html, '<meta (?:property|name)="([^"]*)" content="([^"]*)"', 1)) AS key, unnest(regexp_extract_all(html, '<meta (?:property|name)="([^"]*)" content="([^"]*)"', 2)) AS content, generate_subscripts(regexp_extract_all(html, '<meta (?:property|name)="', 0), 1) AS pos FROM r) SELECT page_id, key, replace(arg_max(content, pos), '&amp;', '&') AS content FROM m GROUP BY ALL""")
def b3(t):
    return pages.meta_rows(t.sql(RICH), ["page_id"])


BIRTH = "CASE page_id % 3 WHEN 0 THEN make_date(1980 + page_id % 35, 1 + page_id % 12, 1 + page_id % 28) WHEN 1 THEN make_date(2001, 1 + page_id % 12, 5) END"


@query("b4_first_date", f"SELECT page_id, cast({BIRTH} AS string) AS birthdate FROM pages")
def b4(t):
    return pages.profiles(t.sql(RICH), ["page_id"]).select("page_id", F.col("birthdate").cast("string").alias("birthdate"))


MEDIA = f"""med AS (SELECT page_id, {HOST} || '/wp-content/uploads/p' || (page_id % 90) || '.jpg' AS media_url, 'og:image' AS kind, NULL AS alt FROM pages
  UNION ALL SELECT page_id, {HOST} || '/wp-content/uploads/x' || (page_id % 50) || '.png', 'img', 'a b' FROM pages UNION ALL SELECT page_id, 'https://cdn.example/wp-content/uploads/shared.webp?w=2', 'img', NULL FROM pages)"""


@query("b5_media_candidates", f"WITH {MEDIA} SELECT page_id, media_url, kind, alt FROM med")
def b5(t):
    return pages.media_candidates(t.sql(RICH), ["page_id"]).drop("pos")


AGE = "date_part('year', date '2020-06-15') - date_part('year', b) - CASE WHEN strftime(date '2020-06-15', '%m%d') < strftime(b, '%m%d') THEN 1 ELSE 0 END"
MANIFEST = f"""{MEDIA}, prof AS (SELECT page_id, url, b, cast({AGE} AS integer) AS age FROM (SELECT page_id, url, {BIRTH} AS b FROM pages)),
man AS (SELECT m.*, p.url AS profile_url, p.age AS age_as_of, regexp_extract(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS slug,
  CASE WHEN age IS NULL THEN 'age_unknown' WHEN age < 20 THEN 'under_min_age_20' END AS exclusion_reason FROM med m JOIN prof p USING (page_id))"""


def manifest(t):
    return pages.candidate_manifest(t.sql(RICH), F.to_date(F.lit("2020-06-15")), 20)


@query("b6_age_eligibility", f"WITH {MANIFEST} SELECT DISTINCT page_id, age_as_of, exclusion_reason IS NULL AS eligible, exclusion_reason FROM man")
def b6(t):
    dates = pages.profiles(t.sql(RICH), ["page_id"]).withColumn("age_as_of", pages.age_on(F.col("birthdate"), F.to_date(F.lit("2020-06-15"))))
    eligible, reason = pages.eligibility(F.col("age_as_of"), 20)
    return dates.select("page_id", "age_as_of", eligible.alias("eligible"), reason.alias("exclusion_reason"))


@query("b7_candidate_manifest", f"WITH {MANIFEST} SELECT slug, media_url, profile_url, kind, age_as_of, exclusion_reason IS NULL AS eligible, row_number() OVER (ORDER BY slug, media_url, profile_url) AS position FROM man")
def b7(t):
    return pages.ordered_manifest(manifest(t)).select("slug", "media_url", "profile_url", "kind", "age_as_of", "eligible", "position")


@query("b8_candidate_audit", f"WITH {MANIFEST} SELECT count(*) AS candidates, count(*) FILTER (exclusion_reason IS NULL) AS eligible, count(*) FILTER (exclusion_reason IS NOT NULL) AS excluded, count(DISTINCT profile_url) AS profiles FROM man")
def b8(t):
    return pages.candidate_audit(manifest(t))


_EXT = "CASE WHEN regexp_matches(split_part(media_url, '?', 1), '\\.(jpg|jpeg|png|webp|bmp)$') THEN regexp_extract(split_part(media_url, '?', 1), '(\\.[a-z]+)$', 1) ELSE '.img' END"
PLAN = f"""{MANIFEST}, plan AS (SELECT *, coalesce(nullif(trim(regexp_replace(slug, '[^a-zA-Z0-9_-]+', '-', 'g'), '-'), ''), 'talent') || '_' || substr(sha1(media_url), 1, 10) || {_EXT} AS target FROM (SELECT *, row_number() OVER (PARTITION BY media_url ORDER BY slug, profile_url, page_id) AS rn FROM man WHERE exclusion_reason IS NULL) WHERE rn = 1)"""


def plan(t):
    return pages.fetch_plan(manifest(t), ["slug", "profile_url", "page_id"])


@query("b9_fetch_plan", f"WITH {PLAN} SELECT media_url, slug, profile_url, target, 'planned' AS status FROM plan")
def b9(t):
    return plan(t).select("media_url", "slug", "profile_url", "target", "status")


MARKED = f"{PLAN}, marked AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN 'skipped' ELSE 'planned' END AS status FROM plan)"


def marked(t):
    """A third of the plan was fetched before, under an older slug."""
    planned = plan(t)
    old = planned.where("page_id % 3 = 0").select(F.concat(F.lit("old_"), F.regexp_extract("target", r"([0-9a-f]{10}\.[a-z]+)$", 1)).alias("file_name"))
    return pages.mark_existing(planned, old)


@query("b10_existing_files", f"WITH {MARKED} SELECT media_url, status, CASE WHEN status = 'skipped' THEN 'old_' || regexp_extract(target, '([0-9a-f]+\\.[a-z]+)$', 1) ELSE target END AS target, CASE WHEN status = 'skipped' THEN 'exists' END AS reason FROM marked")
def b10(t):
    return marked(t).select("media_url", "status", "target", "reason")


@query("b10_status_counts", f"WITH {MARKED} SELECT status, count(*) AS rows FROM marked GROUP BY status")
def b10_counts(t):
    return pages.status_counts(marked(t))


# Links of an order's customer page: one per line item.
LINKS = """SELECT l_orderkey, l_partkey, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pos, CASE l_partkey % 8 WHEN 0 THEN 'https://www.instagram.com/p/' WHEN 1 THEN 'https://instagram.com/User.' || cast(l_partkey AS string) || '/'
  WHEN 2 THEN 'https://x.com/u_' || cast(l_suppkey AS string) || '?s=20' WHEN 3 THEN 'https://twitter.com/Search' WHEN 4 THEN 'https://www.tiktok.com/@tk.' || cast(l_suppkey AS string)
  WHEN 5 THEN 'https://twitter.com/v' || cast(l_partkey AS string) || '/status/1' WHEN 6 THEN 'https://www.tiktok.com/@live#top' ELSE '/local/' || cast(l_partkey AS string) END AS href FROM {lineitem}"""


@query("b11_channel_handles", f"""WITH l AS ({LINKS}), h AS (SELECT l_orderkey, pos, CASE l_partkey % 8 WHEN 1 THEN 'instagram' WHEN 2 THEN 'twitter' WHEN 4 THEN 'tiktok' END AS channel, regexp_extract(href, '([A-Za-z0-9_.]+)(/|[?]s=20)?$', 1) AS handle
  FROM l WHERE l_partkey % 8 IN (1, 2, 4)) SELECT l_orderkey, channel, arg_min(handle, pos) AS handle FROM h GROUP BY ALL""")
def b11(t):
    return pages.channel_handles(t.sql(LINKS), ["l_orderkey"])


FOLLOW_TEXT = f"SELECT event_id, 'about ' || CASE event_id % 7 WHEN 0 THEN cast(user_id AS string) || ',' || lpad(cast(event_id % 1000 AS string), 3, '0') || ' followers' WHEN 1 THEN '1.' || cast(event_id % 10 AS string) || 'K Followers' WHEN 2 THEN cast(user_id AS string) || 'm followers' WHEN 3 THEN '1.5B followers' WHEN 4 THEN cast(event_id AS string) || ' フォロワー' WHEN 5 THEN 'no number followers' ELSE cast(user_id AS string) || ' fans' END AS text FROM {{events}}".replace("{{", "{").replace("}}", "}")


@query("b12_follower_text", f"SELECT event_id, cast(CASE event_id % 7 WHEN 0 THEN user_id * 1000 + event_id % 1000 WHEN 1 THEN 1000 + (event_id % 10) * 100 WHEN 2 THEN user_id * 1000000 WHEN 3 THEN 1500000000 WHEN 4 THEN event_id END AS bigint) AS followers FROM events")
def b12(t):
    return t.sql(FOLLOW_TEXT).select("event_id", pages.follower_count(F.col("text")).alias("followers"))


STAT_HTML = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '<li class=\"a followers\"><b>x</b> <span class=\"n\">1,' || lpad(cast(event_id % 1000 AS string), 3, '0') || '</span></li>' WHEN 1 THEN '<span class=\"followers num\">' || cast(event_id AS string) || '</span>' WHEN 2 THEN '<p>2.5K followers</p>' ELSE '' END || '<span class=\"tweets\">' || cast(user_id AS string) || '</span>' || CASE WHEN user_id % 2 = 0 THEN '<span class=\"following-count\">7,0' || cast(10 + user_id % 90 AS string) || '</span>' ELSE '' END AS html FROM {events}"


@query("b13_class_stats", "SELECT event_id, cast(CASE event_id % 4 WHEN 0 THEN 1000 + event_id % 1000 WHEN 1 THEN event_id WHEN 2 THEN 2500 END AS bigint) AS followers, user_id AS posts, CASE WHEN user_id % 2 = 0 THEN 7010 + user_id % 90 END AS following FROM events")
def b13(t):
    return t.sql(STAT_HTML).select("event_id", *[c.alias(n) for n, c in pages.class_stats(F.col("html")).items()])


_INFO = "'{\"user\": {\"nickname\": \"n' || cast(user_id AS string) || '\", \"signature\": \"\"}, \"stats\": {\"followerCount\": ' || cast(event_id % 700 AS string) || ', \"videoCount\": ' || cast(user_id AS string) || ', \"heartCount\": ' || cast(event_id % 5 AS string) || ', \"diggCount\": 77}}'"
STATE_HTML = f"""SELECT event_id, '<html>' || CASE event_id % 8 WHEN 4 THEN '<script>window.__UNIVERSAL_DATA_FOR_REHYDRATION__ = {{"a": {{"userInfo": ' || {_INFO} || '}}}};</script>'
  WHEN 5 THEN '<meta property="og:title" content="t' || cast(user_id AS string) || '"><meta property="og:description" content="2.5K Followers, fun">'
  ELSE '<script id="SIGI_STATE" type="application/json">' || CASE event_id % 8 WHEN 0 THEN '{{"UserPage": {{"userInfo": ' || {_INFO} || '}}}}' WHEN 1 THEN '{{"userPage": {{"userInfo": ' || {_INFO} || '}}}}'
    WHEN 2 THEN '{{"x": [{{"y": {{"userInfo": ' || {_INFO} || '}}}}]}}' WHEN 6 THEN '{{"z": ' ELSE '{{"z": 1}}' END || '</script>' END || '</html>' AS html FROM EVENTS_TABLE"""


@query("b14_page_state_stats", """SELECT event_id, followers, NULL AS following, posts, total_engagement, CASE WHEN k < 3 AND posts > 0 THEN round(total_engagement / posts / nullif(followers, 0), 6) WHEN k < 5 THEN round(total_engagement / nullif(followers, 0), 6) END AS engagement_rate,
  CASE WHEN k IN (0, 1, 2, 4) THEN 'n' || user_id WHEN k = 5 THEN 't' || user_id END AS display_name, NULL AS bio, CASE WHEN k IN (0, 1, 2, 4) THEN CASE WHEN followers > 0 THEN 'ok' ELSE 'partial' END WHEN k = 5 THEN 'partial' WHEN k = 6 THEN 'error' ELSE 'blocked' END AS fetch_status
FROM (SELECT event_id, user_id, event_id % 8 AS k, CASE WHEN event_id % 8 IN (0, 1, 2, 4) THEN event_id % 700 WHEN event_id % 8 = 5 THEN 2500 END AS followers, CASE WHEN event_id % 8 IN (0, 1, 2, 4) THEN user_id END AS posts,
  CASE WHEN event_id % 8 IN (0, 1, 2, 4) THEN CASE WHEN event_id % 5 = 0 THEN 77 ELSE event_id % 5 END END AS total_engagement FROM events)""")
def b14(t):
    text = STATE_HTML.replace("{", "{{").replace("}", "}}").replace("EVENTS_TABLE", "{events}")
    rows = t.spark.sql(text, events=t.events)
    return pages.page_state_stats(rows, ["event_id"])


PATHS = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '/data/in/u' || cast(user_id AS string) || '/deep/img.png' WHEN 1 THEN '/data/in/u' || cast(user_id AS string) || '/pic.JPG' ELSE '/data/in/solo.v' || cast(user_id AS string) || '.webp' END AS path FROM {events}"


@query("a2_subject_of_path", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'u' || user_id ELSE 'solo.v' || user_id END AS subject FROM events")
def a2(t):
    return t.sql(PATHS).select("event_id", files.subject_of_path(F.col("path"), "/data/in").alias("subject"))


NAMES = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN lpad(cast(event_id AS string), 4, '0') || '_some_name' || cast(user_id AS string) || '_' || substr(md5(cast(event_id AS string)), 1, 10) || '.jpg' WHEN 1 THEN 'name-' || cast(user_id AS string) || '_' || substr(md5(cast(event_id AS string)), 1, 10) || '.png' WHEN 2 THEN 'plain' || cast(user_id AS string) || '.png' ELSE 'short_' || substr(md5('x'), 1, 9) || '.png' END AS file_name FROM {events}"


@query("a3_subject_of_file_name", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'some_name' || user_id WHEN 1 THEN 'name-' || user_id END AS subject FROM events")
def a3(t):
    return t.sql(NAMES).select("event_id", files.subject_of_file_name(F.col("file_name")).alias("subject"))


@query("a3_folders_by_subject", "SELECT CASE event_id % 4 WHEN 0 THEN 'some_name' || user_id WHEN 1 THEN 'name-' || user_id END AS subject, count(*) AS files FROM events WHERE event_id % 4 < 2 GROUP BY ALL")
def a3_folders(t):
    folder = files.scratch(t.spark, "by-subject")
    named = t.sql(NAMES).withColumn("subject", files.subject_of_file_name(F.col("file_name")))
    files.write_by_subject(named, folder)
    return files.read_by_subject(t.spark, folder, named.schema).groupBy("subject").agg(F.count(F.lit(1)).alias("files"))


@query("a4_manifest_read", f"SELECT 'u' || user_id AS subject, max('User ' || user_id) AS name, 'ig_u' || user_id AS instagram FROM events GROUP BY user_id")
def a4(t):
    """Hand-made JSON lines with blank lines in between."""
    records = handle_roster(t).select(F.explode(F.array(F.to_json(F.struct("subject", "name", "handles")), F.lit(""), F.lit("  "))).alias("value"))
    folder = files.scratch(t.spark, "handles")
    records.write.text(folder)
    back = files.read_manifest(t.spark, folder, "subject string, name string, handles map<string,string>")
    return back.select("subject", "name", F.try_element_at("handles", F.lit("instagram")).alias("instagram"))


@query("a5_manifest_round_trip", f"WITH {ENG} SELECT subject, name, channel, handle, followers FROM eng")
def a5(t):
    """A4 and A5: nested records written as JSON lines, read back with their schema, and flattened."""
    nested = eng.nested_records(engagement(t), ["handle", "followers"])
    folder = files.scratch(t.spark, "manifest")
    files.write_manifest(nested, folder)
    back = files.read_manifest(t.spark, folder, nested.schema)
    return back.select("subject", "name", F.explode("engagements").alias("e")).select("subject", "name", "e.*")


REPORT = f"SELECT user_id, {CENTS} AS cents, event_id, CASE event_id % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'plain' ELSE 'object' END AS form FROM {{events}}"


@query("a6_score_reports", f"SELECT event_id, 'u' || user_id AS subject, cents / 100 AS mean_centroid_score, CASE WHEN form <> 'plain' THEN cents / 50 END AS best_centroid_score, CASE WHEN form <> 'plain' THEN event_id END AS item_count FROM ({REPORT})")
def a6(t):
    """Three report forms, one report per event."""
    score, best = (F.col("cents") / 100).alias("mean_centroid_score"), (F.col("cents") / 50).alias("best_centroid_score")
    subject = F.concat(F.lit("u"), "user_id")
    count = F.col("event_id").alias("item_count")
    listed = F.to_json(F.struct(F.array(F.struct(subject.alias("subject"), score, best, count)).alias("subjects")))
    plain, objects = F.to_json(F.create_map(subject, F.col("cents") / 100)), F.to_json(F.create_map(subject, F.struct(score, best, count)))
    text = F.when(F.col("form") == "list", listed).when(F.col("form") == "plain", plain).otherwise(objects)
    return files.score_report_rows(t.sql(REPORT).select("event_id", text.alias("value")), "value")


@query("a7_score_sheet_round_trip", f"WITH {SCORED} SELECT cast(item_id AS string) AS item_id, path, round(centroid_score, 6) AS centroid_score, round(euclidean_to_mean, 6) AS euclidean_to_mean FROM scored")
def a7(t):
    folder = files.scratch(t.spark, "scores")
    files.write_score_sheet(scored(t), folder)
    return files.read_score_sheet(t.spark, folder).select("item_id", "path", r6("centroid_score").alias("centroid_score"), r6("euclidean_to_mean").alias("euclidean_to_mean"))


@query("a8_model_round_trip", f"WITH {ITEM_ROWS}, cen AS ({model('items', 'cohort,')}) SELECT cohort, pos, round(a, 6) AS mean_embedding, round(b, 6) AS median_embedding FROM (SELECT cohort, unnest(mean_v) AS a, unnest(med_v) AS b, generate_subscripts(mean_v, 1) AS pos FROM cen)")
def a8(t):
    folder = files.scratch(t.spark, "models")
    files.save_models(cen.centroid_models(items(t), ["cohort"]), folder)
    return long_vector(files.load_models(t.spark, folder), ["cohort"], "mean_embedding", "median_embedding")


@query("a8_score_with_loaded_model", f"WITH {SCORED} SELECT item_id, round(centroid_score, 6) AS centroid_score FROM scored")
def a8_scores(t):
    folder = files.scratch(t.spark, "models")
    files.save_models(cen.centroid_models(items(t)), folder)
    return sc.score_items(items(t), files.load_models(t.spark, folder)).select("item_id", r6("centroid_score").alias("centroid_score"))
