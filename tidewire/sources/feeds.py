"""Feed documents as items: RSS, Atom and RDF, parsed with Spark's XML functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import BLANK, clean_html, truncated
from tidewire.operators.classify import relevant

TEXT = "struct<_VALUE: string, _href: string>"
LINKS = "array<struct<_VALUE: string, _href: string, _rel: string>>"
MEDIA = "array<struct<_url: string, _href: string, url: string, _type: string, _VALUE: string>>"
ENTRY = ", ".join(
    [
        f"title: {TEXT}, link: {LINKS}, guid: {TEXT}, id: {TEXT}, description: {TEXT}, `content:encoded`: {TEXT}, summary: {TEXT}, content: {TEXT}",
        f"pubDate: {TEXT}, published: {TEXT}, updated: {TEXT}, `dc:date`: {TEXT}",
        f"enclosure: {MEDIA}, `media:content`: {MEDIA}, `media:thumbnail`: {MEDIA}, `media:group`: struct<`media:content`: {MEDIA}>, image: {MEDIA}",
    ]
)
FEED = f"channel struct<item: array<struct<{ENTRY}>>>, entry array<struct<{ENTRY}>>, item array<struct<{ENTRY}>>"
# A summary with this wording says nothing, and hosts whose images can't be shown elsewhere.
READ_MORE = "点击查看原文"
BLOCKED_HOSTS = ["img.36krcdn.com", "static.36kr.com", "static.geekpark.net"]


def title_without_source(title: Column) -> Column:
    """Cuts at the last " - " if more than ten characters come before it."""
    return F.regexp_replace(title, "(?s)^(.{11,}) - .*$", "$1")


def text_of(element: Column) -> Column:
    """An element's text, or else its href attribute."""
    return F.coalesce(element["_VALUE"], element["_href"])


def link_of(links: Column) -> Column:
    """The link of rel="alternate" of several, or else the first."""
    best = F.get(F.filter(links, lambda x: x["_rel"] == "alternate"), F.lit(0))
    return F.coalesce(F.when(F.size(links) > 1, text_of(best)), text_of(F.get(links, F.lit(0))))


def plain_url(url: Column) -> Column:
    """An http(s) URL; "//" gets https; null for anything else."""
    u = F.trim(url)
    return F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.rlike("(?i)^https?://"), u)


def _media(elements: Column) -> Column:
    urls = F.transform(elements, lambda m: plain_url(F.coalesce(F.nullif(m["_url"], F.lit("")), F.nullif(m["_href"], F.lit("")), F.nullif(m["url"], F.lit("")), m["_VALUE"])))
    return F.get(F.filter(urls, lambda u: u.isNotNull()), F.lit(0))


def first_image(html: Column) -> Column:
    """The first image of an HTML fragment."""
    return plain_url(F.nullif(F.regexp_extract(html, "(?i)<img[^>]+src=[\"']([^\"']+)[\"']", 1), F.lit("")))


def image_of(e: Column) -> Column:
    """An entry's image: an enclosure that is one, media elements, or the first in its texts; null from hosts that don't lend them."""
    enclosure = F.get(e["enclosure"], F.lit(0))
    kind = F.coalesce(enclosure["_type"], F.lit(""))
    own = F.when((kind == "") | kind.startswith("image"), _media(e["enclosure"]))
    other = F.coalesce(_media(e["media:content"]), _media(e["media:thumbnail"]), _media(e["media:group"]["media:content"]), _media(e["image"]), *(first_image(e[c]["_VALUE"]) for c in ("content:encoded", "description", "content")))
    host = F.try_parse_url(other, F.lit("HOST"))
    return F.coalesce(own, F.when(~F.coalesce(host.isin(BLOCKED_HOSTS), F.lit(False)), other))


def iso_time(c: Column) -> Column:
    """An instant as ISO text of milliseconds in UTC, from mail dates, ISO texts and "2026-05-29 10:40:19 +0800"; null if it can't be read."""
    s = F.regexp_replace(F.trim(F.regexp_replace(c, f"{BLANK}+", " ")), "^[A-Za-z]{3,9}, ?", "")
    s = F.regexp_replace(s, " (?:GMT|UTC|UT|Z)$", " +0000")
    at = F.coalesce(
        *(F.try_to_timestamp(s, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd HH:mm:ss Z")),
        F.when(s.rlike("^\\d{4}-\\d{2}-\\d{2}"), F.try_to_timestamp(s)),
    )
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def summary_of(e: Column) -> Column:
    """The first text of an entry without markup, at most 180 characters; null if it only says where to read on."""
    raw = F.coalesce(*(F.nullif(text_of(e[c]), F.lit("")) for c in ("description", "content:encoded", "summary", "content")))
    plain = clean_html(raw)
    return F.when((plain != "") & ~F.contains(plain, F.lit(READ_MORE)), truncated(plain, 180))


def feed_items(feeds: DataFrame, limit: int = 20) -> DataFrame:
    """Items of feeds (feed, source, body, and the registry's category, tier, ai_only, strip_source where they are given).

    The first `limit` entries of each feed are taken, without those that lack a title or a link; of feeds marked ai_only, only those
    about AI.  ids are made from the feed and the link.  A body that isn't a feed has no items.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)) if c in feeds.columns else F.lit(False)
    parsed = feeds.withColumn("__feed", F.from_xml("body", FEED, {"mode": "PERMISSIVE"}))
    entries = F.coalesce(F.col("__feed.channel.item"), F.col("__feed.entry"), F.col("__feed.item"))
    e = F.col("e")
    own = [c for c in ("category", "tier") if c in feeds.columns]
    rows = parsed.select("feed", "source", *own, flag("ai_only").alias("ai_only"), flag("strip_source").alias("strip"), F.posexplode(F.slice(entries, 1, limit)).alias("ord", "e"))
    title = F.trim(F.coalesce(text_of(e["title"]), F.lit("")))
    link = F.trim(F.coalesce(F.nullif(link_of(e["link"]), F.lit("")), F.nullif(text_of(e["guid"]), F.lit("")), text_of(e["id"])))
    time = F.coalesce(*(F.nullif(text_of(e[c]), F.lit("")) for c in ("pubDate", "published", "updated", "dc:date")))
    out = rows.select(
        F.concat_ws("-", "feed", F.substring(F.sha1(link), 1, 10)).alias("id"),
        "source",
        *own,
        F.col("ord").cast("long").alias("ord"),
        F.when(F.col("strip"), F.trim(title_without_source(title))).otherwise(title).alias("title"),
        link.alias("source_url"),
        summary_of(e).alias("summary"),
        iso_time(time).alias("published_at"),
        image_of(e).alias("image"),
        F.lit(True).alias("ai_selected"),
        F.col("feed").alias("origin"),
        "ai_only",
    ).where("title <> '' and source_url <> ''")
    about = relevant(F.concat_ws(" ", "title", F.coalesce("summary", F.lit(""))))
    return out.where(~F.col("ai_only") | about).drop("ai_only")


def rss_items(feeds: DataFrame, limit: int = 20, strip_source: bool = False) -> DataFrame:
    """(source, ord, title, source_url, summary, published_at) of feeds (source, body); see feed_items."""
    named = feeds.select(F.col("source").alias("feed"), "source", "body", F.lit(strip_source).alias("strip_source"))
    return feed_items(named, limit).select("source", "ord", "title", "source_url", "summary", "published_at")
