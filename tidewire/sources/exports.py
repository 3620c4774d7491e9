"""Static exports: a feed document, a sitemap, linked-data lists and JSON endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import clean_html, escaped


def rss_entries(items: DataFrame, limit: int = 30) -> DataFrame:
    """(place, entry): the latest items as RSS item elements; the summary or else the title is the description."""
    order = [F.coalesce("published_at", F.lit("")).desc(), F.col("id")]
    top = items.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), escaped(c), F.lit(f"</{name}>"))
    text = F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.col("title"))
    return top.select("place", F.concat(F.lit("<item>"), tag("title", F.col("title")), tag("link", F.coalesce("source_url", F.lit(""))), tag("guid", F.col("id").cast("string")), tag("description", text), F.lit("</item>")).alias("entry"))


def sitemap(base: str, topics: DataFrame, days: DataFrame, fixed: list[str], least: int = 5) -> DataFrame:
    """URLs of fixed pages, of topics with enough items, and of days."""
    pages = topics.sparkSession.createDataFrame([(f"{base}{p}",) for p in fixed], "url string")
    some = topics.where(F.col("n") >= least).select(F.concat(F.lit(f"{base}/topic/"), "tag").alias("url"))
    return pages.unionByName(some).unionByName(days.select(F.concat(F.lit(f"{base}/daily/"), "day").alias("url")))


def linked_data(items: DataFrame, columns: list[str]) -> Column:
    """A JSON object of columns that is safe inside a script element."""
    return F.replace(F.to_json(F.struct(*columns)), F.lit("<"), F.lit("\\u003c"))


def feed_entries(items: DataFrame, now: str, limit: int = 30) -> DataFrame:
    """(place, entry): the latest items as full RSS items; the description is the note, or else the summary as plain text, or else the title."""
    order = [F.coalesce("published_at", F.lit("")).desc(), F.col("id")]
    top = items.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # limit rows
    tag = lambda name, c, more="": F.concat(F.lit(f"<{name}{more}>"), escaped(c), F.lit(f"</{name}>"))
    filled = lambda c: F.when(c != "", c)
    note = [filled(F.col("ai_note"))] if "ai_note" in items.columns else []
    text = F.coalesce(*note, filled(clean_html(F.col("summary"))), F.col("title"))
    date = F.date_format(F.coalesce(F.try_to_timestamp("published_at"), F.to_timestamp(F.lit(now))), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    parts = [tag("title", F.col("title")), tag("link", F.coalesce("source_url", F.lit(""))), tag("guid", F.col("id").cast("string"), ' isPermaLink="false"'), tag("source", F.col("source")), tag("pubDate", date), tag("description", text)]
    return top.select("place", F.concat(F.lit("<item>"), *parts, F.lit("</item>")).alias("entry"))


def list_document(items: DataFrame, columns: list[str], order: list[Column], limit: int = 20) -> DataFrame:
    """One row (document): the first items as a JSON array that is safe inside a script element."""
    top = items.orderBy(*order).limit(limit).withColumn("__n", F.row_number().over(Window.orderBy(*order)))  # limit rows
    rows = F.transform(F.array_sort(F.collect_list(F.struct("__n", F.struct(*columns).alias("v")))), lambda x: x["v"])
    return top.agg(F.replace(F.to_json(rows), F.lit("<"), F.lit("\\u003c")).alias("document"))


def sources_list(items: DataFrame) -> DataFrame:
    """(source, n) of all sources, those of most items first."""
    return items.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


def latest_days(items: DataFrame, days: int = 30) -> DataFrame:
    """Items of the latest days, by first_seen or else published_at."""
    times = [c for c in ("first_seen", "published_at") if c in items.columns]
    keyed = items.withColumn("day", F.substring(F.coalesce(*times, F.lit("")), 1, 10)).where("day <> ''")
    return keyed.join(F.broadcast(keyed.select("day").distinct().orderBy(F.desc("day")).limit(days)), "day")  # as many rows as days


def digest_of(items: DataFrame, picks: DataFrame) -> DataFrame:
    """One row (date, picks) of a digest (date, place, id, reason): what is picked, in order, with the items' titles and sources; no row without picks."""
    each = picks.join(items.select("id", "title", "source"), "id", "left")
    row = each.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("place", "id", "title", "source", "reason"))).alias("picks"))
    return row.orderBy(F.desc("date")).limit(1)


def latest_of(recent: DataFrame) -> DataFrame:
    """One row (date, count, items) of the last of some days' items (day, ...), in the order of their ids."""
    last = recent.join(F.broadcast(recent.agg(F.max("day").alias("day"))), "day")  # one row
    return last.groupBy(F.col("day").alias("date")).agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("id")).alias("items"))


def write_endpoints(items: DataFrame, path: str, stories: DataFrame | None = None, repos: DataFrame | None = None, top: int = 500, per_category: int = 100, days: int = 30, top_stories: int = 50, meta: DataFrame | None = None, picks: DataFrame | None = None) -> None:
    """JSON files under path: the hottest items, each category's, each of the latest days', the last day's, the list of days, the sources, the
    metadata (of the items, where none is given), and the digest, stories and repositories where there are any."""
    from tidewire.sources.snapshots import meta_of

    order = [F.coalesce("heat", F.lit(0)).desc(), F.col("id")]
    one = lambda frame, name: frame.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")  # noqa: E731  small tables
    one(items.orderBy(*order).limit(top), "items")
    rank = F.row_number().over(Window.partitionBy("category").orderBy(*order))
    items.withColumn("rank", rank).where(F.col("rank") <= per_category).write.mode("overwrite").partitionBy("category").json(f"{path}/categories")
    recent = latest_days(items, days)
    recent.write.mode("overwrite").partitionBy("day").json(f"{path}/days")
    one(recent.groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")), "index")
    one(sources_list(items), "sources")
    one(meta if meta is not None else meta_of(items), "meta")
    one(latest_of(recent), "latest")
    if picks is not None:
        one(digest_of(items, picks), "digest")
    if stories is not None:
        one(stories.orderBy(F.desc("n_sources"), "story").limit(top_stories), "stories")
    if repos is not None:
        repos.write.mode("overwrite").json(f"{path}/repos")


def write_insights(insights: DataFrame, path: str) -> None:
    """Weekly insights (label, insight) as JSON, a folder for each week; empty ones don't take the place of what is there."""
    some = insights.where("insight <> ''").withColumn("week", F.substring("label", 1, 10))
    some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").json(path)
