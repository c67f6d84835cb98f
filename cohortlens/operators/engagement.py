"""Channel engagement: cleaning, rates, imports, merges, and a profile cache with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import pick, r6

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
USABLE = ["ok", "partial"]


def clean_count(text: Column) -> Column:
    """``1,234``, ``1.2K``, ``3M`` to a whole number, truncated; anything that is no number (``n/a``, ``-``) gives null."""
    plain = F.upper(F.replace(F.trim(text), F.lit(","), F.lit("")))
    factor = pick((plain.endswith("K"), 1e3), (plain.endswith("M"), 1e6), otherwise=1.0)
    value = F.rtrim(plain, F.lit("KM")).try_cast("double") * factor
    return F.when(plain.rlike(_NUMBER + "[KM]?$"), value.try_cast("bigint"))


def clean_rate(text: Column) -> Column:
    """``1.5%`` as a fraction, ``0.015`` as it is; anything that is no number gives null."""
    trimmed = F.trim(text)
    value = F.rtrim(trimmed, F.lit("%")).try_cast("double")
    return F.when(trimmed.rlike(_NUMBER + "%*$"), F.when(trimmed.endswith("%"), value / 100).otherwise(value))


def engagement_rate(total: Column, followers: Column, posts: Column) -> Column:
    """Per post and follower if there are posts, else per follower; null without followers."""
    per_account = total / F.nullif(followers, F.lit(0))
    per_post = total / F.nullif(posts, F.lit(0)) / F.nullif(followers, F.lit(0))
    return r6(F.when(posts > 0, per_post).otherwise(per_account))


def profile_url(channel: Column, handle: Column) -> Column:
    """Profile address forms of the known channels; any other channel by its own name."""
    return pick(
        (channel == "instagram", F.concat(F.lit("https://www.instagram.com/"), handle, F.lit("/"))),
        (channel.isin("twitter", "x"), F.concat(F.lit("https://x.com/"), handle)),
        (channel == "tiktok", F.concat(F.lit("https://www.tiktok.com/@"), handle)),
        otherwise=F.concat(F.lit("https://"), channel, F.lit(".com/"), handle),
    )


def _text(column: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(column), F.lit(""))), F.lit(""))


def import_rows(raw: DataFrame) -> DataFrame:
    """Text rows of a manual sheet to engagement rows: trimmed, cleaned, incomplete rows dropped, rate filled in."""
    named = raw.withColumns(
        {
            "subject": F.trim("subject"),
            "channel": F.lower(F.trim("channel")),
            "handle": F.ltrim(F.trim("handle"), F.lit("@")),
            "display_name": _text("display_name"),
            "bio": _text("bio"),
            **{c: clean_count(F.col(c)) for c in ("followers", "following", "posts", "total_engagement")},
            "engagement_rate": clean_rate(F.col("engagement_rate")),
        }
    ).where("subject != '' AND channel != '' AND handle != ''")
    backfill = engagement_rate(F.col("total_engagement"), F.col("followers"), F.col("posts"))
    return named.withColumns(
        {
            "engagement_rate": F.coalesce("engagement_rate", backfill),
            "profile_url": profile_url(F.col("channel"), F.col("handle")),
            "fetch_status": F.when(F.col("followers").isNotNull(), "ok").otherwise("partial"),
        }
    )


def _keep_one(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Row with the largest order value per key, as one mergeable aggregate."""
    fields = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("r")).select(*keys, "r.*")


def merge_engagement(existing: DataFrame, imported: DataFrame, overwrite: bool = True, order: str = "seq") -> DataFrame:
    """One row per (subject, channel) whatever the handle.

    Overwriting, the last imported row wins; otherwise an existing row stays and only the first new one is added.
    """
    columns = [c for c in existing.columns if c in imported.columns]
    both = existing.select(*columns, F.lit(0).alias("__new")).unionByName(imported.select(*columns, F.lit(1).alias("__new")))
    direction = F.col(order) if overwrite else -F.col(order)
    newest = F.col("__new") if overwrite else -F.col("__new")
    return _keep_one(both, ["subject", "channel"], F.struct(newest.alias("n"), direction.alias("o"))).drop("__new")


def merge_channels(roster: DataFrame, photo: DataFrame, short_text: DataFrame, video: DataFrame) -> DataFrame:
    """Three channel tables joined onto the handle roster; subjects without any channel drop out.

    ``photo`` (subject, handle, followers, status) and ``video`` (+ posts, hearts) fall back to the roster's handle;
    ``short_text`` rows are complete already.
    """
    who = roster.select("subject", "name", "handles")

    def handle(channel: str) -> Column:
        return F.coalesce(F.col("handle"), F.try_element_at("handles", F.lit(channel)), F.lit(""))

    def status() -> Column:
        return F.when(F.col("followers").isNotNull(), "ok").otherwise(F.coalesce("status", F.lit("partial")))

    none_int, none_rate = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    a = who.join(photo, "subject").select(
        "subject", "name", F.lit("instagram").alias("channel"), handle("instagram").alias("handle"), "followers",
        none_int.alias("posts"), none_int.alias("total_engagement"), none_rate.alias("engagement_rate"), status().alias("fetch_status"))
    b = who.join(short_text, "subject").select(
        "subject", "name", F.lit("twitter").alias("channel"), "handle", "followers", "posts", "total_engagement", "engagement_rate", "fetch_status")
    rate = engagement_rate(F.col("hearts"), F.col("followers"), F.col("posts"))
    c = who.join(video, "subject").select(
        "subject", "name", F.lit("tiktok").alias("channel"), handle("tiktok").alias("handle"), "followers", "posts",
        F.col("hearts").alias("total_engagement"), rate.alias("engagement_rate"), status().alias("fetch_status"))
    return a.unionByName(b).unionByName(c)


def post_rollup(posts: DataFrame, followers: DataFrame, keys: list[str]) -> DataFrame:
    """Posts to one row per account: likes + comments, averages (1 decimal), rate per post and follower."""
    totals = posts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("likes").alias("likes"), F.sum("comments").alias("comments")
    )
    joined = followers.join(totals, keys, "left")
    total = F.col("likes") + F.col("comments")
    return joined.select(
        *keys, "followers",
        F.round(F.col("likes") / F.col("n"), 1).alias("avg_likes"),
        F.round(F.col("comments") / F.col("n"), 1).alias("avg_comments"),
        total.alias("total_engagement"),
        r6(total / F.col("n") / F.nullif(F.col("followers"), F.lit(0))).alias("engagement_rate"),
        F.when(F.col("followers").isNotNull(), "ok").otherwise("partial").alias("fetch_status"),
    )


def fresh(cache: DataFrame, as_of: Column, ttl_hours: float = 168.0) -> DataFrame:
    """Cache rows not older than the time to live (a row exactly that old is still fresh)."""
    age = F.unix_micros(as_of) - F.unix_micros(F.col("fetched_at").cast("timestamp"))
    return cache.where(age <= int(ttl_hours * 3600 * 1_000_000))


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: Column, ttl_hours: float = 168.0) -> DataFrame:
    """Requested (channel, handle) pairs found fresh in the cache; handles compare in lower case."""
    wanted = requests.withColumn("handle_key", F.lower("handle")).select("channel", "handle_key").distinct()
    stored = fresh(cache, as_of, ttl_hours).withColumn("handle_key", F.lower("handle"))
    return stored.join(wanted, ["channel", "handle_key"], "left_semi").drop("handle_key")


def cache_upsert(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """Latest row per (channel, lower-case handle)."""
    both = cache.unionByName(fetched).withColumn("handle", F.lower("handle"))
    return _keep_one(both, ["channel", "handle"], F.col("fetched_at"))


def cache_invalidate(cache: DataFrame, dropped: DataFrame) -> DataFrame:
    gone = dropped.select("channel", F.lower("handle").alias("handle"))
    return cache.withColumn("handle", F.lower("handle")).join(gone, ["channel", "handle"], "left_anti")


def usable(profiles: DataFrame, need_followers: bool = True) -> DataFrame:
    """Profiles a batch may reuse: ok or partial and, for batches, with a follower count."""
    good = F.col("fetch_status").isin(*USABLE)
    return profiles.where(good & F.col("followers").isNotNull() if need_followers else good)


def split_requests(
    requests: DataFrame, cache: DataFrame, as_of: Column, ttl_hours: float = 168.0, force: bool = False, need_followers: bool = True
) -> DataFrame:
    """Every request as ``cached`` or ``fetch``; ``force`` sends all to ``fetch``.  A single fetch reuses profiles without followers too."""
    if force:
        return requests.withColumn("plan", F.lit("fetch"))
    hits = usable(fresh(cache, as_of, ttl_hours), need_followers).select("channel", F.lower("handle").alias("__key")).distinct()
    joined = requests.withColumn("__key", F.lower("handle")).join(hits.withColumn("__hit", F.lit(True)), ["channel", "__key"], "left")
    return joined.withColumn("plan", F.when(F.col("__hit"), "cached").otherwise("fetch")).drop("__key", "__hit")


# For these channels a source is accepted by a rule of its own; all others take ok or partial with followers.
STRICT_FIRST = ["twitter"]  # the first source only if ok, a later one with whatever status if it has followers; else the first


def first_usable(results: DataFrame, keys: list[str], priority: str = "priority") -> DataFrame:
    """Per account the first source in priority order that its channel accepts; without one, the last tried (strict channels: the first)."""
    known = F.col("followers").isNotNull()
    strict = F.coalesce(F.col("channel").isin(*STRICT_FIRST), F.lit(False))
    results = results.join(results.groupBy(*keys).agg(F.min(priority).alias("__first")), keys)
    lenient = F.when(F.col(priority) == F.col("__first"), (F.col("fetch_status") == "ok") & known).otherwise(known)
    good = F.when(strict, lenient).otherwise(F.col("fetch_status").isin(*USABLE) & known)
    good = F.coalesce(good, F.lit(False))
    rank = F.col(priority)
    order = F.struct(good.cast("int").alias("g"), F.when(good | strict, -rank).otherwise(rank).alias("p"))
    return _keep_one(results, keys, order).drop("__first")


def handle_rows(records: DataFrame, channels: list[str]) -> DataFrame:
    """Handle maps to one row per (channel, handle, subject) of the wanted channels."""
    return records.select("subject", "name", F.explode("handles").alias("channel", "handle")).where(F.col("channel").isin(*channels))


def nested_records(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Engagement rows nested per subject.  One entry per (subject, channel): merge first, so lists stay channel-sized."""
    return rows.groupBy("subject").agg(
        F.max("name").alias("name"), F.array_sort(F.collect_list(F.struct("channel", *fields))).alias("engagements")
    )


def cache_rows_from_records(records: DataFrame) -> DataFrame:
    """Nested records flattened to cache rows; entries without followers are left out."""
    return records.select("subject", F.explode("engagements").alias("e")).select("subject", "e.*").where(F.col("followers").isNotNull())


def cache_rows_from_batch(batch: DataFrame, roster: DataFrame, channel: str = "instagram") -> DataFrame:
    """Keyed batch results to cache rows: own handle, else the roster's handle of the key, else the key itself."""
    known = roster.select(F.col("subject").alias("key"), F.try_element_at("handles", F.lit(channel)).alias("__roster"))
    named = batch.join(known, "key", "left").withColumn(
        "handle", F.coalesce(F.nullif("handle", F.lit("")), F.nullif("__roster", F.lit("")), F.col("key"))
    )
    kept = named.where((F.col("handle") != "") & F.col("followers").isNotNull())
    return kept.select(F.lit(channel).alias("channel"), "handle", "followers", F.lit("ok").alias("fetch_status"))


def name_relevance(name: Column, display: Column, handle: Column) -> Column:
    """.8 if one name contains the other (spaces and case ignored), else .3 if the handle holds its first three letters."""
    a = F.replace(F.lower(name), F.lit(" "), F.lit(""))
    b = F.replace(F.lower(display), F.lit(" "), F.lit(""))
    return pick(
        (F.contains(b, a) | F.contains(a, b), 0.8), (F.contains(F.lower(handle), F.left(a, F.lit(3))), 0.3), otherwise=0.0
    )


def coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows, rows with followers (non-zero), and subjects per channel or status."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("followers") > 0).alias("with_followers"),
        F.count_distinct("subject").alias("subjects"),
    )
