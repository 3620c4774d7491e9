"""Reports and home page: leads, hero, navigation, candidates of the digest, ranges of trends, and checks of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import day

DIGEST_LEAST, DIGEST_POOL, DIGEST_HOURS = 5, 18, 72
DEAD_SOURCES = 5


def newest(items: DataFrame) -> list[str]:
    return [c for c in ("published_at", "first_seen") if c in items.columns]


def by_importance(items: DataFrame) -> list[Column]:
    """Heat, then time."""
    return [F.coalesce("heat", F.lit(0)).desc(), F.coalesce(*newest(items), F.lit("")).desc(), F.col("id")]


def selected(items: DataFrame) -> DataFrame:
    return items.where(~F.col("ai_selected").eqNullSafe(False))


def trending(items: DataFrame, now: str, n: int = 8, days: int = 7) -> DataFrame:
    """The hottest selected items of the last days."""
    some = selected(items).where(F.try_to_timestamp("published_at") >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days"))
    return some.orderBy(F.coalesce("heat", F.lit(0)).desc(), "id").limit(n)


def hero(items: DataFrame) -> DataFrame:
    """The most important selected item with an image; none if there is none."""
    return selected(items).where("image is not null and image <> ''").orderBy(*by_importance(items)).limit(1)


def leads(items: DataFrame, key: str = "day") -> DataFrame:
    """(key, id, title): the newest item with a summary of each day, or else the newest."""
    first = F.struct((F.coalesce(F.length("summary"), F.lit(0)) > 0).cast("int").alias("s"), F.coalesce("published_at", F.lit("")).alias("t"), (-F.col("id")).alias("i"))
    return items.groupBy(key).agg(F.max_by(F.struct("id", "title"), first).alias("x")).select(key, "x.id", "x.title")


def daily_index(items: DataFrame, now: str, days: int = 30, least: int = 3) -> DataFrame:
    """(day, n, lead): days of first_seen within the last ones that have enough items, and the title that leads each."""
    rows = items.withColumn("day", day(F.col("first_seen"))).where("day <> ''")
    since = F.date_format(F.date_sub(F.to_date(F.lit(now[:10])), days), "yyyy-MM-dd")
    counts = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n")).where((F.col("day") >= since) & (F.col("n") >= least))
    return counts.join(leads(rows), "day").select("day", "n", F.col("title").alias("lead"))


def neighbours(days: DataFrame) -> DataFrame:
    """(day, previous, next) of a list of days, which is as long as the archive has days."""
    order = Window.orderBy("day")
    return days.select("day", F.lag("day").over(order).alias("previous"), F.lead("day").over(order).alias("next"))


def new_since(items: DataFrame, last_visit: str) -> DataFrame:
    """One row (n): items first seen after a visit."""
    return items.agg(F.count_if(F.try_to_timestamp("first_seen") > F.to_timestamp(F.lit(last_visit))).alias("n"))


def fresh(items: DataFrame, snapshot: str, hours: int = 24) -> DataFrame:
    """Items first seen within a day of the snapshot."""
    return items.where(F.try_to_timestamp("first_seen") >= F.to_timestamp(F.lit(snapshot)) - F.expr(f"interval {hours} hours"))


def digest_candidates(items: DataFrame, now: str) -> DataFrame:
    """The 18 hottest selected items of the last 72 hours; of all items if fewer than five are that young."""
    at = F.try_to_timestamp(F.coalesce(*newest(items)))
    young = ~F.col("ai_selected").eqNullSafe(False) & (F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(at) < DIGEST_HOURS * 3600)
    marked = items.withColumn("__young", F.coalesce(young, F.lit(False)))
    enough = F.broadcast(marked.agg((F.count_if("__young") >= DIGEST_LEAST).alias("__enough")))  # one row
    some = marked.join(enough).where("__young or not __enough").drop("__young", "__enough")
    return some.orderBy(F.coalesce("heat", F.lit(0)).desc(), "id").limit(DIGEST_POOL)


def last_rows(series: DataFrame, n: int, key: str = "day") -> DataFrame:
    """The last n days that a series has, which may be further apart than n days."""
    return series.join(F.broadcast(series.select(key).distinct().orderBy(F.desc(key)).limit(n)), key)  # n rows


def between(series: DataFrame, first: str, last: str, key: str = "day") -> DataFrame:
    return series.where(F.col(key).between(first, last))


def crawl_report(counts: DataFrame, errors: DataFrame, most: int = DEAD_SOURCES) -> DataFrame:
    """One row (sources, errors, rows, failed) of a crawl: maps of counts (source, n) and errors (source, error), and whether it failed.

    It failed if nothing was written, or if more than five sources did; the validator's message is no source's.  Error texts are cut
    at 200 characters.
    """
    n = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    e = errors.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.substring("error", 1, 200))))).alias("errors"), F.count_if(F.col("source") != "validator").alias("dead"))
    return n.join(e).select("sources", "errors", "rows", "dead", ((F.col("dead") > most) | (F.col("rows") == 0)).alias("failed"))


def section_sizes(sections: Column) -> Column:
    """The number of items in an array of sections with items."""
    return F.aggregate(sections, F.lit(0), lambda n, s: n + F.size(s["items"]))


def _ids(rows: DataFrame, order: list[Column], n: int, name: str) -> DataFrame:
    """One row: the ids of the first n rows in order."""
    some = rows.orderBy(*order).limit(n).withColumn("__n", F.row_number().over(Window.orderBy(*order)))  # n rows
    return some.agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "id"))), lambda x: x["id"]).alias(name))


# The words of a day's lead, after the day, and before and after the number of items.
LEAD = (" · AI 资讯日报", "今日新收录 ", " 条公开资讯，按模型 / 产品 / 行业 / 论文 / 观点 自动归类汇编（非 AI 生成，点击可溯源原文）。")


def daily_report(items: DataFrame, target: str, categories: list[str], featured: int = 6, flashes: int = 6, per_section: int = 5) -> DataFrame:
    """One row (day, n, lead, featured, sections, flashes) of a day's items: arrays of ids; sections in the order of categories, empty ones too.

    lead is a struct (title, paragraph) that says what was compiled, null for a day without items.
    """
    rows = items.where(day(F.col("first_seen")) == target)
    order = by_importance(rows)
    top = rows.withColumn("__n", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("__n") <= per_section)
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct("__n", "id")))), lambda x: x["id"])
    sections = top.agg(F.array(*(F.struct(F.lit(c).alias("category"), ids(c).alias("items")) for c in categories)).alias("sections"))
    parts = rows.agg(F.count(F.lit(1)).alias("n")).join(_ids(selected(rows), order, featured, "featured")).join(sections)
    parts = parts.join(_ids(rows, [F.coalesce("published_at", F.lit("")).desc(), F.col("id")], flashes, "flashes"))  # one row each
    paragraph = F.concat(F.lit(LEAD[1]), F.col("n").cast("string"), F.lit(LEAD[2]))
    lead = F.when(F.col("n") > 0, F.struct(F.lit(target + LEAD[0]).alias("title"), paragraph.alias("paragraph")))
    return parts.select(F.lit(target).alias("day"), "n", lead.alias("lead"), "featured", "sections", "flashes")
