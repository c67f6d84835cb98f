"""Queries: engagement tables and the profile cache.  Events are posts; users are subjects; event types are channels."""

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import engagement as eng
from .registry import query

CHANNEL = "CASE event_type WHEN 'click' THEN 'instagram' WHEN 'view' THEN 'twitter' WHEN 'purchase' THEN 'tiktok' ELSE event_type END"
CENTS = "cast(round(value * 100) AS bigint)"
ENGAGEMENT = f"""SELECT 'u' || cast(user_id AS string) AS subject, CASE WHEN user_id % 13 = 0 THEN NULL ELSE 'User ' || cast(user_id AS string) END AS name,
  {CHANNEL} AS channel, 'H' || cast(user_id AS string) || '_' || event_type AS handle,
  CASE WHEN user_id % 11 = 0 AND event_type = 'click' THEN NULL WHEN user_id % 17 = 0 THEN cast(0 AS bigint) ELSE cast(sum(event_id % 5000) AS bigint) END AS followers,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE count(*) END AS posts, cast(sum({CENTS}) AS bigint) AS total_engagement,
  max(ts) AS fetched_at, max(event_id) AS seq FROM {{events}} GROUP BY user_id, event_type"""
RATE = "round(CASE WHEN posts > 0 THEN total_engagement / nullif(posts, 0) / nullif(followers, 0) ELSE total_engagement / nullif(followers, 0) END, 6)"
ENG = f"eng AS (SELECT *, {RATE} AS engagement_rate FROM ({ENGAGEMENT}))"


def engagement(t):
    rate = eng.engagement_rate(F.col("total_engagement"), F.col("followers"), F.col("posts"))
    return t.sql(ENGAGEMENT).withColumn("engagement_rate", rate)


# A hand-kept sheet: one text row per event, with the usual mess.
SHEET = f"""SELECT event_id, ' u' || cast(user_id AS string) || ' ' AS subject, CASE WHEN event_id % 23 = 0 THEN ' ' ELSE upper({CHANNEL}) END AS channel,
  CASE WHEN event_id % 2 = 0 THEN '@' ELSE '' END || 'h' || cast(user_id AS string) AS handle,
  CASE event_id % 8 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN ' ' || cast(user_id AS string) || ',' || lpad(cast(event_id % 1000 AS string), 3, '0') || ' '
    WHEN 3 THEN cast(user_id AS string) || '.' || cast(event_id % 10 AS string) || 'K' WHEN 4 THEN '1.' || cast(event_id % 100 AS string) || 'm'
    WHEN 5 THEN cast({CENTS} AS string) || '.75' WHEN 6 THEN 'None' ELSE cast({CENTS} AS string) END AS followers,
  '-' AS following, CASE WHEN event_id % 3 = 0 THEN '0' WHEN event_id % 3 = 1 THEN '' ELSE cast(1 + event_id % 40 AS string) END AS posts,
  cast({CENTS} AS string) AS total_engagement,
  CASE event_id % 5 WHEN 0 THEN '1.' || cast(event_id % 10 AS string) || '%' WHEN 1 THEN '0.0' || cast(event_id % 10 AS string) WHEN 2 THEN 'bad' ELSE '' END AS engagement_rate,
  CASE WHEN event_id % 4 = 0 THEN ' ' ELSE ' Name ' END AS display_name, '' AS bio, event_id AS seq FROM {{events}}"""


def _count_sql(c):
    x = f"replace(trim({c}), ',', '')"
    body = f"CASE WHEN upper(right({x}, 1)) IN ('K', 'M') THEN left({x}, length({x}) - 1) ELSE {x} END"
    return f"CASE WHEN lower(trim({c})) NOT IN ('', 'null', 'none', 'n/a', '-') THEN cast(trunc(try_cast({body} AS double) * CASE upper(right({x}, 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 ELSE 1e0 END) AS bigint) END"


def _rate_sql(c):
    return f"CASE WHEN lower(trim({c})) NOT IN ('', 'null', 'none', 'n/a', '-') THEN try_cast(replace(trim({c}), '%', '') AS double) / CASE WHEN contains({c}, '%') THEN 100e0 ELSE 1e0 END END"


@query("n1_clean_numbers", f"SELECT event_id, {_count_sql('followers')} AS followers, {_count_sql('posts')} AS posts, round({_rate_sql('engagement_rate')}, 6) AS engagement_rate FROM ({SHEET})")
def n1(t):
    return t.sql(SHEET).select(
        "event_id", eng.clean_count(F.col("followers")).alias("followers"), eng.clean_count(F.col("posts")).alias("posts"),
        r6(eng.clean_rate(F.col("engagement_rate"))).alias("engagement_rate"),
    )


@query("n2_engagement_rate", f"WITH {ENG} SELECT subject, channel, engagement_rate FROM eng")
def n2(t):
    return engagement(t).select("subject", "channel", "engagement_rate")


IMPORTED = f"""raw AS ({SHEET}), num AS (SELECT event_id, seq, trim(subject) AS subject, lower(trim(channel)) AS channel, ltrim(trim(handle), '@') AS handle, {_count_sql('followers')} AS followers, {_count_sql('posts')} AS posts,
  {_count_sql('total_engagement')} AS total_engagement, {_rate_sql('engagement_rate')} AS given_rate, nullif(trim(display_name), '') AS display_name FROM raw WHERE trim(channel) <> ''),
imp AS (SELECT *, round(coalesce(given_rate, {RATE}), 6) AS engagement_rate, CASE WHEN followers IS NOT NULL THEN 'ok' ELSE 'partial' END AS fetch_status,
  CASE WHEN channel = 'instagram' THEN 'https://www.instagram.com/' || handle || '/' WHEN channel IN ('twitter', 'x') THEN 'https://x.com/' || handle WHEN channel = 'tiktok' THEN 'https://www.tiktok.com/@' || handle ELSE 'https://' || channel || '.com/' || handle END AS profile_url FROM num)"""
_IMPORT_COLUMNS = ["subject", "channel", "handle", "followers", "posts", "total_engagement", "engagement_rate", "fetch_status", "profile_url"]


def imported(t):
    return eng.import_rows(t.sql(SHEET)).withColumn("engagement_rate", r6("engagement_rate"))


@query("n3_import_sheet", f"WITH {IMPORTED} SELECT event_id, display_name, {', '.join(_IMPORT_COLUMNS)} FROM imp")
def n3(t):
    return imported(t).select("event_id", "display_name", *_IMPORT_COLUMNS)


_MERGED = ["handle", "followers", "posts", "total_engagement", "engagement_rate", "fetch_status", "seq"]


def existing(t):
    """Engagement of before: what is a twitter row now was on a channel of its own."""
    channel = F.when(F.col("channel") == "twitter", "photoblog").otherwise(F.col("channel"))
    status = F.when(F.col("followers").isNotNull(), "ok").otherwise("partial")
    return engagement(t).withColumns({"fetch_status": status, "channel": channel}).select("subject", "channel", *_MERGED)


EXISTING = f"{ENG}, old AS (SELECT subject, CASE WHEN channel = 'twitter' THEN 'photoblog' ELSE channel END AS channel, {', '.join(c for c in _MERGED if c != 'fetch_status')}, CASE WHEN followers IS NOT NULL THEN 'ok' ELSE 'partial' END AS fetch_status FROM eng)"


def _merge_sql(order):
    cols = "subject, channel, " + ", ".join(_MERGED)
    return f"WITH {EXISTING}, {IMPORTED}, both_rows AS (SELECT {cols}, 0 AS fresh FROM old UNION ALL SELECT {cols}, 1 AS fresh FROM imp) SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY subject, channel ORDER BY {order}) AS rn FROM both_rows) WHERE rn = 1"


@query("n4_merge_overwrite", _merge_sql("fresh DESC, seq DESC"))
def n4(t):
    return eng.merge_engagement(existing(t), imported(t).select("subject", "channel", *_MERGED))


@query("n4_merge_keep", _merge_sql("fresh, seq"))
def n4_keep(t):
    return eng.merge_engagement(existing(t), imported(t).select("subject", "channel", *_MERGED), overwrite=False)


ROSTER = "SELECT 'u' || cast(user_id AS string) AS subject, max('User ' || cast(user_id AS string)) AS name FROM {events} GROUP BY user_id"


def handle_roster(t):
    """Subjects with a handle map of two channels."""
    return t.sql(ROSTER).withColumn(
        "handles", F.create_map(F.lit("instagram"), F.concat(F.lit("ig_"), "subject"), F.lit("tiktok"), F.concat(F.lit("tk_"), "subject"))
    )


MERGE_CHANNELS = f"""WITH {ENG}, roster AS ({ROSTER}), ig AS (SELECT subject, CASE WHEN seq % 2 = 0 THEN handle END AS handle, followers, CASE WHEN seq % 3 = 0 THEN 'blocked' END AS status FROM eng WHERE channel = 'instagram'),
tw AS (SELECT * REPLACE (CASE WHEN seq % 5 = 0 THEN 'x' ELSE '' END || subject AS subject) FROM eng WHERE channel = 'twitter'), tk AS (SELECT subject, CASE WHEN seq % 2 = 1 THEN handle END AS handle, followers, posts, total_engagement AS hearts FROM eng WHERE channel = 'tiktok')
SELECT subject, name, 'instagram' AS channel, coalesce(handle, 'ig_' || subject) AS handle, followers, NULL::BIGINT AS posts, NULL::BIGINT AS total_engagement, NULL::DOUBLE AS engagement_rate, CASE WHEN followers IS NOT NULL THEN 'ok' ELSE coalesce(status, 'partial') END AS fetch_status FROM roster JOIN ig USING (subject)
UNION ALL SELECT subject, roster.name, 'twitter', handle, followers, posts, total_engagement, engagement_rate, 'ok' FROM roster JOIN tw USING (subject)
UNION ALL SELECT subject, name, 'tiktok', coalesce(handle, 'tk_' || subject), followers, posts, hearts, {RATE.replace('total_engagement', 'hearts')}, CASE WHEN followers IS NOT NULL THEN 'ok' ELSE 'partial' END FROM roster JOIN tk USING (subject)"""


@query("n5_merge_channels", MERGE_CHANNELS)
def n5(t):
    rows = engagement(t)
    stranger = F.concat(F.when(F.col("seq") % 5 == 0, "x").otherwise(""), "subject")  # one in five is not on the roster
    photo = rows.where("channel = 'instagram'").select(
        "subject", F.when(F.col("seq") % 2 == 0, F.col("handle")).alias("handle"), "followers", F.when(F.col("seq") % 3 == 0, "blocked").alias("status"))
    text = rows.where("channel = 'twitter'").withColumns({"fetch_status": F.lit("ok"), "subject": stranger}).drop("name", "channel")
    video = rows.where("channel = 'tiktok'").select(
        "subject", F.when(F.col("seq") % 2 == 1, F.col("handle")).alias("handle"), "followers", "posts",
        F.col("total_engagement").alias("hearts"), F.lit(None).cast("string").alias("status"))
    return eng.merge_channels(handle_roster(t), photo, text, video)


POSTS = f"SELECT 'u' || cast(user_id AS string) AS subject, {CHANNEL} AS channel, {CENTS} AS likes, event_id % 50 AS comments FROM {{events}}"


@query("n6_post_rollup", f"WITH {ENG}, posts AS ({POSTS}), p AS (SELECT subject, channel, count(*) AS n, cast(sum(likes) AS bigint) AS likes, cast(sum(comments) AS bigint) AS comments FROM posts GROUP BY ALL) SELECT subject, channel, followers, round(likes / n, 1) AS avg_likes, round(comments / n, 1) AS avg_comments, likes + comments AS total_engagement, round((likes + comments) / n / nullif(followers, 0), 6) AS engagement_rate, CASE WHEN followers IS NOT NULL THEN 'ok' ELSE 'partial' END AS fetch_status FROM eng LEFT JOIN p USING (subject, channel)")
def n6(t):
    return eng.post_rollup(t.sql(POSTS), t.sql(ENGAGEMENT).select("subject", "channel", "followers"), ["subject", "channel"])


AS_OF = "2024-01-31 00:00:00"
CACHE = f"{ENG}, cache AS (SELECT channel, handle, followers, fetched_at, CASE WHEN seq % 4 = 0 THEN 'blocked' WHEN followers IS NULL THEN 'partial' ELSE 'ok' END AS fetch_status FROM eng)"
FRESH = f"{CACHE}, fresh AS (SELECT * FROM cache WHERE epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(fetched_at) <= 86400000000)"
REQUESTS = f"SELECT DISTINCT {CHANNEL} AS channel, 'h' || cast(user_id AS string) || '_' || event_type AS handle FROM {{events}}"
_HOURS = 24.0


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def cache(t):
    status = F.when(F.col("seq") % 4 == 0, "blocked").when(F.col("followers").isNull(), "partial").otherwise("ok")
    return t.sql(ENGAGEMENT).withColumn("fetch_status", status).select("channel", "handle", "followers", "fetched_at", "fetch_status")


@query("n7_cache_lookup", f"WITH {FRESH} SELECT channel, handle, followers, fetch_status, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM fresh WHERE (channel, lower(handle)) IN (SELECT (channel, handle) FROM ({REQUESTS}))")
def n7(t):
    return eng.cache_lookup(t.sql(REQUESTS), cache(t), as_of(), _HOURS).withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


FETCHED = f"SELECT {CHANNEL} AS channel, CASE WHEN value > 100 THEN 'h' || cast(user_id AS string) || '_' || event_type ELSE 'new_' || cast(event_id AS string) END AS handle, event_id % 900 AS followers, ts + INTERVAL 1 DAY AS fetched_at, 'ok' AS fetch_status FROM {{events}}"


@query("n8_cache_upsert", f"WITH {CACHE}, u AS (SELECT channel, lower(handle) AS handle, followers, fetched_at, fetch_status FROM cache UNION ALL SELECT * FROM ({FETCHED})) SELECT channel, handle, followers, fetch_status, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY channel, handle ORDER BY u.fetched_at DESC) AS rn FROM u) WHERE rn = 1")
def n8(t):
    rows = eng.cache_upsert(cache(t), t.sql(FETCHED))
    return rows.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


@query("n8_cache_invalidate", f"WITH {CACHE} SELECT channel, lower(handle) AS handle, followers, fetch_status, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM cache WHERE (channel, lower(handle)) NOT IN (SELECT (channel, handle) FROM ({FETCHED}))")
def n8_invalidate(t):
    return eng.cache_invalidate(cache(t), t.sql(FETCHED)).withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


@query("n9_request_split", f"WITH {FRESH}, hit AS (SELECT channel, lower(handle) AS handle FROM fresh WHERE fetch_status IN ('ok', 'partial') AND followers IS NOT NULL) SELECT channel, handle, CASE WHEN (channel, handle) IN (SELECT (channel, handle) FROM hit) THEN 'cached' ELSE 'fetch' END AS plan FROM ({REQUESTS})")
def n9(t):
    return eng.split_requests(t.sql(REQUESTS), cache(t), as_of(), _HOURS)


SOURCES = f"SELECT {CHANNEL} AS channel, 'u' || cast(user_id AS string) AS handle, event_id AS priority, CASE WHEN value < 20 THEN 'blocked' WHEN value < 30 THEN 'partial' ELSE 'ok' END AS fetch_status, CASE WHEN event_id % 3 = 0 THEN NULL ELSE {CENTS} END AS followers FROM {{events}}"


@query("n10_source_fallback", f"WITH s AS ({SOURCES}), g AS (SELECT *, followers IS NOT NULL AND CASE WHEN channel <> 'twitter' THEN fetch_status IN ('ok', 'partial') WHEN priority = min(priority) OVER (PARTITION BY channel, handle) THEN fetch_status = 'ok' ELSE true END AS good FROM s) SELECT channel, handle, priority, fetch_status, followers FROM (SELECT *, row_number() OVER (PARTITION BY channel, handle ORDER BY good DESC, CASE WHEN good OR channel = 'twitter' THEN priority ELSE -priority END) AS rn FROM g) WHERE rn = 1")
def n10(t):
    return eng.first_usable(t.sql(SOURCES), ["channel", "handle"])


@query("n11_handle_rows", f"WITH r AS ({ROSTER}) SELECT subject, name, 'tiktok' AS channel, 'tk_' || subject AS handle FROM r")
def n11(t):
    return eng.handle_rows(handle_roster(t), ["tiktok", "twitter"])


@query("n11_nested_records", f"WITH {ENG} SELECT subject, max(name) AS name, count(*) AS engagement_count, string_agg(channel || ':' || handle, ';' ORDER BY channel) AS handles FROM eng GROUP BY subject")
def n11_nested(t):
    nested = eng.nested_records(engagement(t), ["handle", "followers"])
    pairs = F.transform("engagements", lambda e: F.concat_ws(":", e["channel"], e["handle"]))
    return nested.select("subject", "name", F.size("engagements").cast("bigint").alias("engagement_count"), F.array_join(pairs, ";").alias("handles"))


BATCH = f"{ENG}, batch AS (SELECT CASE WHEN seq % 3 = 0 THEN 'x' || subject ELSE subject END AS key, CASE WHEN seq % 4 = 0 THEN handle WHEN seq % 4 = 1 THEN '' END AS handle, followers FROM eng WHERE channel = 'instagram')"


@query("n12_cache_load", f"WITH {BATCH}, roster AS ({ROSTER}) SELECT 'instagram' AS channel, coalesce(nullif(handle, ''), CASE WHEN roster.subject IS NOT NULL THEN 'ig_' || roster.subject END, key) AS handle, followers, 'ok' AS fetch_status FROM batch LEFT JOIN roster ON roster.subject = key WHERE followers IS NOT NULL")
def n12(t):
    batch = t.sql(ENGAGEMENT).where("channel = 'instagram'").select(
        F.when(F.col("seq") % 3 == 0, F.concat(F.lit("x"), "subject")).otherwise(F.col("subject")).alias("key"),
        F.when(F.col("seq") % 4 == 0, F.col("handle")).when(F.col("seq") % 4 == 1, "").alias("handle"), "followers",
    )
    return eng.cache_rows_from_batch(batch, handle_roster(t))


@query("n12_cache_load_records", f"WITH {ENG} SELECT subject, channel, handle, followers FROM eng WHERE followers IS NOT NULL")
def n12_records(t):
    return eng.cache_rows_from_records(eng.nested_records(engagement(t), ["handle", "followers"]))


NAMES = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) || ' Official' WHEN c_custkey % 3 = 1 THEN 'fan page' ELSE c_mktsegment END AS display, CASE WHEN c_custkey % 2 = 0 THEN 'customer_' ELSE 'x' END || cast(c_custkey AS string) AS handle, replace(c_name, '#', ' ') AS name FROM {customer}"


@query("n13_name_relevance", f"WITH n AS (SELECT *, replace(lower(name), ' ', '') AS a, replace(lower(replace(display, '#', ' ')), ' ', '') AS b FROM ({NAMES})) SELECT c_custkey, cast(CASE WHEN contains(b, a) OR contains(a, b) THEN 0.8 WHEN contains(lower(handle), a[1:3]) THEN 0.3 ELSE 0 END AS double) AS relevance FROM n")
def n13(t):
    display = F.replace("display", F.lit("#"), F.lit(" "))
    return t.sql(NAMES).select("c_custkey", eng.name_relevance(F.col("name"), display, F.col("handle")).alias("relevance"))


@query("n14_coverage", f"WITH {CACHE} SELECT e.channel, CASE WHEN seq % 4 = 0 THEN 'blocked' WHEN followers IS NULL THEN 'partial' ELSE 'ok' END AS fetch_status, count(*) AS rows, count(*) FILTER (followers > 0) AS with_followers, count(DISTINCT subject) AS subjects FROM eng e GROUP BY ALL")
def n14(t):
    status = F.when(F.col("seq") % 4 == 0, "blocked").when(F.col("followers").isNull(), "partial").otherwise("ok")
    return eng.coverage(engagement(t).withColumn("fetch_status", status), ["channel", "fetch_status"])
