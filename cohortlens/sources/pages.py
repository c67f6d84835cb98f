"""Rows from stored web pages (url, html): links, titles, meta tags, dates, media candidates, handles and counts.

All parsing is column work on the page row; the fetch itself is not part of this package.
"""

from __future__ import annotations

import html as html_text
import json

from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scale
from ..functions.numeric import pick
from ..operators.engagement import engagement_rate

# Fixed values.
MEDIA_PATTERN = r"(?i)\.(?:jpg|jpeg|png|webp|bmp)(?:\?|$)"
MEDIA_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".bmp"]
MEDIA_FOLDER = "/wp-content/uploads/"
MEDIA_DENIED = ["favicon", "logo", "cropped-"]
DATE_PATTERN = r"(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日"
WIDE_DIGITS = "０１２３４５６７８９"
SOURCE_POLICY = "manifest_only_review_before_download"
HANDLE_PATTERNS = {
    "instagram": r"(?:www\.)?instagram\.com/([A-Za-z0-9_.](?:[A-Za-z0-9_.]{0,29}))/?(?:\?|$|#)",
    "twitter": r"(?:www\.)?(?:twitter|x)\.com/([A-Za-z0-9_]{1,15})/?(?:\?|$|#)",
    "tiktok": r"(?:www\.)?tiktok\.com/@([A-Za-z0-9_.]{2,24})/?(?:\?|$|#)",
}
IGNORED_HANDLES = {
    "instagram": ["p", "reel", "reels", "explore", "stories", "tv", "accounts", "web", "direct", "login", "signup", "challenge", "legal"],
    "twitter": ["intent", "share", "home", "i", "settings", "privacy", "tos", "en", "login", "signup", "search", "explore", "notifications"],
    "tiktok": ["login", "signup", "trending", "live", "music", "foryou", "explore", "discover", "tag", "sound", "effect", "embed"],
}
FOLLOWER_PATTERN = r"([0-9,]+(?:\.[0-9]+)?[KMBkmb]?)\s*(?:フォロワー|followers|Followers)"

_ATTRS = r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)"  # the inside of a tag; a quoted '>' does not end it

# Name and value of an attribute; read from the left, so that nothing inside a quoted value is taken for a name.
_PAIR = r"(?s)[^\s=/>\"']+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)"


@F.arrow_udf(T.StringType())
def unescape(values: pa.Array) -> pa.Array:
    """Character references (&amp; &#39; ...) to text."""
    return pa.array([v if v is None or "&" not in v else html_text.unescape(v) for v in values.to_pylist()], pa.string())


def markup(page: Column) -> Column:
    """The page without comments and without the inside of scripts and styles, where tags do not count."""
    return F.regexp_replace(F.regexp_replace(page, r"(?s)<!--.*?-->", ""), r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", "$1$3")


def shown(page: Column) -> Column:
    """The page without comments; scripts and styles stay."""
    return F.regexp_replace(page, r"(?s)<!--.*?-->", "")


def plain_digits(text: Column) -> Column:
    """Full-width digits as ASCII ones."""
    return F.translate(text, WIDE_DIGITS, "0123456789")


def tag_attributes(clean: Column, tag: str) -> Column:
    """Attribute text of every such tag of ``markup``, in page order."""
    return F.regexp_extract_all(clean, F.lit(rf"(?is)<{tag}(?=[\s/>]){_ATTRS}>"), F.lit(1))


def with_markup(pages: DataFrame) -> DataFrame:
    """Pages with their cleaned markup in ``__clean``: scanned once, whatever is extracted from it."""
    return scale.spread(pages).withColumn("__clean", markup(F.col("html")))


def attribute(attributes: Column, name: str) -> Column:
    """Value of one attribute (quoted or bare), null if it is missing or empty."""
    named = F.filter(F.regexp_extract_all(attributes, F.lit(_PAIR), F.lit(0)), lambda p: F.lower(F.regexp_extract(p, r"^[^\s=]+", 0)) == name)
    value = F.regexp_extract(F.try_element_at(named, F.lit(1)), r"(?s)^[^\s=]+\s*=\s*(.*)$", 1)
    return F.nullif(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit(""))


_URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


@F.arrow_udf(T.StringType())
def resolve_url(bases: pa.Array, links: pa.Array) -> pa.Array:
    """Absolute address of a link (an attribute value as written) found on the page ``base``; null if it cannot be read."""

    def joined(base, link):
        try:
            return None if base is None or link is None else urljoin(base, html_text.unescape(link))
        except ValueError:
            return None

    return pa.array(map(joined, bases.to_pylist(), links.to_pylist()), pa.string())


def page_links(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, href) of every anchor, in page order; href as written."""
    rows = with_markup(pages).select(*keys, F.posexplode(tag_attributes(F.col("__clean"), "a")).alias("pos", "__attrs"))
    return rows.select(*keys, "pos", attribute(F.col("__attrs"), "href").alias("href")).where(F.col("href").isNotNull())


def first_seen(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per (keys, value) at its first position."""
    others = [c for c in rows.columns if c not in (*keys, value, "pos")]
    packed = F.min(F.struct("pos", *others)).alias("f")
    return rows.groupBy(*keys, value).agg(packed).select(*keys, value, F.col("f.pos").alias("pos"), *[F.col(f"f.{c}").alias(c) for c in others])


def site_links(pages: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Same-host links under a path prefix (not the prefix itself), with one trailing slash and without query, first seen once."""
    resolved = page_links(pages, [*keys, "url"]).withColumn("__link", resolve_url("url", "href"))
    path = F.concat(F.regexp_replace(url_part(F.col("__link"), 3), "/+$", ""), F.lit("/"))
    rows = resolved.select(
        *keys, "pos", path.alias("__path"),
        F.concat(F.lower(url_part(F.col("__link"), 1)), F.lit("://"), url_part(F.col("__link"), 2), path).alias("link"),
        (url_part(F.col("__link"), 2) == url_part(F.col("url"), 2)).alias("__same"),
    )
    kept = rows.where(F.col("__same") & F.col("__path").startswith(prefix) & (F.col("__path") != prefix))
    return first_seen(kept.select(*keys, "pos", "link"), keys, "link")


def metas(clean: Column) -> Column:
    """Meta tags as an array of (key, content); key is ``property`` or else ``name``."""
    pairs = F.transform(
        tag_attributes(clean, "meta"),
        lambda a: F.struct(F.coalesce(attribute(a, "property"), attribute(a, "name")).alias("key"), attribute(a, "content").alias("value")),
    )
    return F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())


def last_meta(pairs: Column, key: str) -> Column:
    """Content of the last meta tag with this key."""
    return F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(-1))["value"]


def meta_rows(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The meta map in long form (keys, key, content), the last tag of a key winning."""
    rows = with_markup(pages).select(*keys, F.posexplode(metas(F.col("__clean"))).alias("pos", "m"))
    latest = rows.groupBy(*keys, F.col("m.key").alias("key")).agg(F.max_by("m.value", "pos").alias("content"))
    return latest.withColumn("content", unescape("content"))


def clean_name(title: Column) -> Column:
    """Text before the first ``|``, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.substring_index(title, "|", 1)), F.lit(""))


def iso_date(text: Column) -> Column:
    """First year-month-day date of a text as an ISO date."""
    parts = [F.regexp_extract(plain_digits(text), DATE_PATTERN, i).try_cast("int") for i in (1, 2, 3)]
    return F.try_to_date(F.format_string("%04d-%02d-%02d", *parts), "yyyy-MM-dd")


def body_text(page: Column) -> Column:
    return F.regexp_replace(page, r"(?s)<[^>]*>", " ")


def _profile_columns() -> list[Column]:
    """name and birthdate of a page with its meta pairs in ``__m``."""
    title = F.nullif(F.regexp_extract(shown(F.col("html")), r"(?is)<title[^>]*>(.*?)</title\s*>", 1), F.lit(""))
    dates = [iso_date(last_meta(F.col("__m"), "description")), iso_date(last_meta(F.col("__m"), "og:description")), iso_date(body_text(shown(F.col("html"))))]
    name = clean_name(unescape(F.coalesce(last_meta(F.col("__m"), "og:title"), F.trim(title))))
    return [name.alias("name"), F.coalesce(*dates).alias("birthdate")]


def profiles(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Name (social title, else page title), and the first date in description, social description, body, in that order."""
    return with_markup(pages).withColumn("__m", metas(F.col("__clean"))).select(*keys, *_profile_columns())


def is_media(url: Column) -> Column:
    lowered = F.lower(url)
    denied = F.exists(F.array(*[F.lit(d) for d in MEDIA_DENIED]), lambda d: F.contains(lowered, d))
    return lowered.rlike(MEDIA_PATTERN) & F.contains(lowered, F.lit(MEDIA_FOLDER)) & ~denied


def media_candidates(pages: DataFrame, keys: list[str], with_profile: bool = False) -> DataFrame:
    """(keys, pos, media_url, kind, alt): social images, then image sources, then links to images; each address once.

    ``with_profile`` adds url, name and birthdate from the same parse of the page.
    """
    page = F.col("__clean")
    entry = lambda url, kind, alt: F.struct(url.alias("raw"), F.lit(kind).alias("kind"), alt.alias("alt"))
    nothing = F.lit(None).cast("string")
    social = F.array(*[entry(last_meta(F.col("__m"), k), k, nothing) for k in ("og:image", "twitter:image")])
    sources = ("src", "data-src", "data-lazy-src", "srcset", "data-srcset")
    images = F.flatten(
        F.transform(tag_attributes(page, "img"), lambda a: F.array(*[entry(attribute(a, s), "img", attribute(a, "alt")) for s in sources]))
    )
    targets = F.filter(F.transform(tag_attributes(page, "a"), lambda a: attribute(a, "href")), lambda h: h.rlike(MEDIA_PATTERN))
    links = F.transform(targets, lambda h: entry(h, "link", nothing))
    profile = _profile_columns() if with_profile else []
    found = with_markup(pages).withColumn("__m", metas(page)).select(
        *keys, "url", *profile, F.posexplode(F.concat(social, images, links)).alias("pos", "e")
    )
    first = F.trim(F.substring_index(F.trim(F.substring_index("e.raw", ",", 1)), " ", 1))
    kept = ["url", "name", "birthdate"] if with_profile else []
    rows = (
        found.where(F.col("e.raw").isNotNull())
        .withColumn("media_url", resolve_url(F.col("url"), first))
        .select(*keys, *kept, "pos", "media_url", F.col("e.kind").alias("kind"), unescape("e.alt").alias("alt"))
        .where(is_media(F.col("media_url")))
    )
    return first_seen(rows, keys, "media_url")


def age_on(birthdate: Column, as_of: Column) -> Column:
    """Whole years; a birthday not yet reached in the year does not count."""
    before = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (F.month(birthdate) * 100 + F.dayofmonth(birthdate))
    return F.year(as_of) - F.year(birthdate) - before.cast("int")


def eligibility(age: Column, min_age: int, include_all: bool = False) -> tuple[Column, Column]:
    """(eligible, exclusion reason); unknown ages and ages below the minimum are excluded unless overridden."""
    reason = pick((age.isNull(), "age_unknown"), (age < min_age, f"under_min_age_{min_age}"))
    if include_all:
        return F.lit(True), F.lit(None).cast("string")
    return reason.isNull(), reason


def slug_of(url: Column) -> Column:
    """Last path segment of an address."""
    return F.element_at(F.split(F.regexp_replace(url_part(url, 3), "/+$", ""), "/"), -1)


def candidate_manifest(
    pages: DataFrame, as_of: Column, min_age: int, key: str = "page_id", include_all: bool = False,
    retrieved_at: Column | None = None,
) -> DataFrame:
    """One row per (page, media) with the page's name, date, age and eligibility; ``retrieved_at`` is the time of the job unless given."""
    rows = media_candidates(pages, [key], with_profile=True)
    aged = rows.withColumn("age_as_of", age_on(F.col("birthdate"), as_of))
    eligible, reason = eligibility(F.col("age_as_of"), min_age, include_all)
    return aged.select(
        key, F.col("url").alias("profile_url"), slug_of(F.col("url")).alias("slug"), "name", F.col("birthdate").cast("string").alias("birthdate"),
        "age_as_of", "media_url", "kind", "alt", eligible.alias("eligible"), reason.alias("exclusion_reason"),
        (F.current_timestamp() if retrieved_at is None else retrieved_at).cast("string").alias("retrieved_at"),
        F.lit(SOURCE_POLICY).alias("source_policy"),
    )


def candidate_audit(candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    return candidates.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("eligible").alias("eligible"),
        F.count_if(~F.col("eligible")).alias("excluded"),
        F.count_distinct("profile_url").alias("profiles"),
    )


def media_extension(url: Column) -> Column:
    path = F.lower(url_part(url, 3))
    return pick(*[(path.endswith(e), e) for e in MEDIA_EXTENSIONS], otherwise=".img")


def target_name(slug: Column, url: Column) -> Column:
    """``{clean slug}_{first 10 of sha1(url)}{extension}``."""
    cleaned = F.regexp_replace(F.regexp_replace(slug, r"[^a-zA-Z0-9_-]+", "-"), r"^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("talent")), F.lit("_"), F.substring(F.sha1(url), 1, 10), media_extension(url))


def fetch_plan(candidates: DataFrame, order: list[str], include_ineligible: bool = False, limit: int | None = None) -> DataFrame:
    """Eligible candidates, each address once (the first in order), with target names; ``limit`` caps the plan if given."""
    wanted = candidates if include_ineligible else candidates.where("eligible")
    others = [c for c in wanted.columns if c != "media_url"]
    first = wanted.groupBy("media_url").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select("media_url", "r.*")
    named = first.withColumns({"target": target_name(F.col("slug"), F.col("media_url")), "status": F.lit("planned")})
    return named if limit is None else named.orderBy(*order).limit(limit)


def mark_existing(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned rows whose file exists become ``skipped``: under the target's own name, else, whatever the slug, under the
    smallest name with the same address digest and extension."""
    tail = lambda c: F.regexp_extract(c, r"_([0-9a-f]{10}\.[a-z]+)$", 1)
    names = existing.select("file_name").distinct()
    same = names.select(F.col("file_name").alias("target"), F.col("file_name").alias("__same"))
    have = names.groupBy(tail(F.col("file_name")).alias("__tail")).agg(F.min("file_name").alias("__older"))
    joined = plan.withColumn("__tail", tail(F.col("target"))).join(same, "target", "left").join(have, "__tail", "left")
    joined = joined.withColumn("__file", F.coalesce("__same", "__older")).drop("__same", "__older")
    exists = F.col("__file").isNotNull()
    return joined.withColumns(
        {
            "status": F.when(exists, "skipped").otherwise(F.col("status")),
            "target": F.coalesce("__file", "target"),
            "reason": F.when(exists, "exists"),
        }
    ).drop("__tail", "__file")


def status_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


def channel_handles(links: DataFrame, keys: list[str]) -> DataFrame:
    """First account handle per channel among a page's links (keys, pos, href); navigation paths are not handles."""
    found = F.array(
        *[
            F.struct(F.lit(channel).alias("channel"), F.regexp_extract("href", pattern, 1).alias("handle"))
            for channel, pattern in HANDLE_PATTERNS.items()
        ]
    )
    ignored = F.array(*[F.lit(f"{c}/{h}") for c, names in IGNORED_HANDLES.items() for h in names])
    rows = links.select(*keys, "pos", F.explode(found).alias("h")).select(*keys, "pos", "h.*").where(F.col("handle") != "")
    kept = rows.where(~F.array_contains(ignored, F.concat_ws("/", "channel", F.lower("handle"))))
    return kept.groupBy(*keys, "channel").agg(F.min_by("handle", "pos").alias("handle"))


def follower_count(text: Column) -> Column:
    """``1,234 followers``, ``1.2K followers``, ``3M`` or ``1B`` forms to a whole number, truncated."""
    raw = F.replace(F.regexp_extract(plain_digits(text), FOLLOWER_PATTERN, 1), F.lit(","), F.lit(""))
    suffix = F.lower(F.regexp_extract(raw, r"([KMBkmb])$", 1))
    factor = pick((suffix == "k", 1e3), (suffix == "m", 1e6), (suffix == "b", 1e9), otherwise=1.0)
    return (F.regexp_replace(raw, "[KMBkmb]$", "").try_cast("double") * factor).try_cast("bigint")


def _stat(page: Column, pattern: str) -> Column:
    return F.replace(F.regexp_extract(page, pattern, 1), F.lit(","), F.lit("")).try_cast("bigint")


def class_stats(page: Column) -> dict[str, Column]:
    """Followers, posts and following from class-marked spans, with the text form as last resort for followers."""
    span = r"(?s)<span[^>]*class=\"[^\"]*{}[^\"]*\"[^>]*>([0-9,]+)</span>"
    item = r"(?s)<li[^>]*class=\"[^\"]*followers[^\"]*\"[^>]*>.*?<span[^>]*>([0-9,]+)</span>"
    return {
        "followers": F.coalesce(_stat(page, item), _stat(page, span.format("followers")), follower_count(page)),
        "posts": _stat(page, span.format("tweets")),
        "following": _stat(page, span.format("following")),
    }


# The scripts a page keeps its state in.
STATE_PATTERN = r'(?s)<script[^>]+id="SIGI_STATE"[^>]*>(.*?)</script>'
REHYDRATION_PATTERN = r"(?s)<script[^>]*>\s*window\.__UNIVERSAL_DATA_FOR_REHYDRATION__\s*=\s*(\{.*?\})\s*;?\s*</script>"
_BROKEN = "!"  # stands for a state that is no JSON


def _user_info(parents: tuple[str, ...]):
    """Kernel: ``userInfo`` of a page state as JSON, under the first of ``parents`` that has it, else wherever it occurs."""

    @F.arrow_udf(T.StringType())
    def user_info(documents: pa.Array) -> pa.Array:
        def search(state):
            """The first entry of that name, parents before children and in the order of the text; its own depth is no limit."""
            waiting = [state]
            while waiting:
                node = waiting.pop()
                if isinstance(node, dict) and "userInfo" in node:
                    if node["userInfo"] is not None:
                        return node["userInfo"]
                elif isinstance(node, (dict, list)):
                    waiting.extend(reversed(list(node.values() if isinstance(node, dict) else node)))
            return None

        def read(text):
            if not text:
                return None
            try:
                state = json.loads(text)
            except (ValueError, RecursionError):  # no JSON, or nested deeper than the reader goes
                return _BROKEN
            known = [state.get(parent) for parent in parents] if isinstance(state, dict) else []
            found = next((k["userInfo"] for k in known if isinstance(k, dict) and k.get("userInfo")), None) or search(state)
            try:
                return json.dumps(found, ensure_ascii=False) if found else None
            except RecursionError:
                return _BROKEN

        return pa.array(map(read, documents.to_pylist()), pa.string())

    return user_info


def _stats(info: str) -> Column:
    """The numbers and names of a ``userInfo``; null where it has no numbers."""
    stats = F.get_json_object(info, "$.stats")
    number = lambda name: F.get_json_object(stats, f"$.{name}").try_cast("bigint")
    text = lambda name: F.nullif(F.get_json_object(info, f"$.user.{name}"), F.lit(""))
    fields = F.struct(
        number("followerCount").alias("followers"), number("followingCount").alias("following"), number("videoCount").alias("posts"),
        F.coalesce(F.nullif(number("heartCount"), F.lit(0).cast("bigint")), number("diggCount")).alias("total_engagement"),
        text("nickname").alias("display_name"), text("signature").alias("bio"),
    )
    return F.when(stats.isNotNull() & ~stats.isin("{}", "[]", "null", '""', "0", "false"), fields)


def page_state_stats(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Profile numbers of every page: from its embedded state, else from its second form of state, else from the social description.

    A state that is no JSON makes the row an ``error``.  The second form gives no ``following`` and its rate is per account.
    Without any number the row is ``blocked``.
    """
    first, second = _user_info(("UserPage", "userPage")), _user_info(())
    rows = with_markup(pages).withColumn("__m", metas(F.col("__clean"))).select(
        *keys,
        first(F.regexp_extract("html", STATE_PATTERN, 1)).alias("__a"),
        second(F.regexp_extract("html", REHYDRATION_PATTERN, 1)).alias("__b"),
        follower_count(unescape(last_meta(F.col("__m"), "og:description"))).alias("__followers"),
        unescape(last_meta(F.col("__m"), "og:title")).alias("__title"),
    )
    rows = rows.withColumns({"__sa": _stats("__a"), "__sb": _stats("__b")})
    broken = F.coalesce(F.col("__a") == _BROKEN, F.lit(False)) | (F.col("__sa").isNull() & F.coalesce(F.col("__b") == _BROKEN, F.lit(False)))
    later = F.col("__sb.followers").isNotNull()
    named = F.col("__sb").withField("following", F.lit(None).cast("bigint"))
    described = F.struct(
        F.col("__followers").alias("followers"), *[F.lit(None).cast("bigint").alias(c) for c in ("following", "posts", "total_engagement")],
        F.col("__title").alias("display_name"), F.lit(None).cast("string").alias("bio"),
    )
    chosen = F.when(broken, None).when(F.col("__sa").isNotNull(), F.col("__sa")).when(later, named).otherwise(described)
    told = rows.select(*keys, broken.alias("__broken"), "__sa", later.alias("__later"), chosen.alias("s")).select(*keys, "__broken", "__sa", "__later", "s.*")
    counted = F.col("followers") > 0
    rate_posts = F.when(F.col("__sa").isNotNull(), F.col("posts"))
    status = (
        F.when(F.col("__broken"), "error")
        .when(F.col("__sa").isNotNull() | F.col("__later"), F.when(counted, "ok").otherwise("partial"))
        .otherwise(F.when(counted, "partial").otherwise("blocked"))
    )
    return told.select(
        *keys, "followers", "following", "posts", "total_engagement", engagement_rate(F.col("total_engagement"), F.col("followers"), rate_posts).alias("engagement_rate"),
        "display_name", "bio", status.alias("fetch_status"),
    )


def ordered_manifest(candidates: DataFrame, key: str = "page_id") -> DataFrame:
    """Manifest order: slug, then address, as positions (a global sort without a single task).

    Pages that share an address follow by ``key``, so the positions are the same in every run.
    """
    order = ["slug", "media_url", "profile_url", key, "kind", "alt"]
    return scale.row_numbers(candidates, [], [F.col(c) for c in order], "position")
