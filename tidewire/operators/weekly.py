"""Weekly reports: sources, categories, summaries, and insights joined to their weeks; selections for pictures and the command palette."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.daily import by_importance, selected


def top_sources(items: DataFrame, n: int = 8) -> DataFrame:
    """(source, n) of the sources with the most items."""
    return items.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(n)


def category_breakdown(items: DataFrame, categories: list[str]) -> DataFrame:
    """(place, category, n) of every category in its order, those without items too."""
    counts = items.agg(*(F.count_if(F.col("category") == c).alias(f"n{k}") for k, c in enumerate(categories)))
    rows = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c).alias("category"), F.col(f"n{k}").alias("n")) for k, c in enumerate(categories)))
    return counts.select(F.inline(rows))


def best_category(items: DataFrame, categories: list[str]) -> DataFrame:
    """One row: the category with the most items, the first of equals; empty and 0 where there are none."""
    each = category_breakdown(items, categories).agg(F.max_by(F.struct("category", "n"), F.struct("n", -F.col("place"))).alias("x"))
    return each.select(F.when(F.col("x.n") > 0, F.col("x.category")).otherwise("").alias("category"), F.col("x.n").alias("n"))


def _firsts(c: str, n: int, keep: Column | None = None) -> Column:
    """The values of a column of the first n rows by __n."""
    rows = F.array_sort(F.collect_list(F.when(keep if keep is not None else F.lit(True), F.struct("__n", F.col(c).alias("v")))))
    return F.transform(F.slice(rows, 1, n), lambda x: x["v"])


def section_summaries(items: DataFrame, labels: dict[str, str], per: int = 5) -> DataFrame:
    """(category, n, summary) of each category's first items by importance: two notes, or else a sentence with three titles."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(*by_importance(items)))
    top = items.withColumn("__n", rank).where(F.col("__n") <= per)
    noted = F.coalesce("ai_note", F.lit("")) != ""
    out = top.groupBy("category").agg(F.count(F.lit(1)).alias("n"), _firsts("title", 3).alias("t"), _firsts("ai_note", 2, noted).alias("a"))
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in labels.items() for x in p)), F.col("category")), F.col("category"))
    text = F.concat(F.lit("本周"), label, F.lit("方向共 "), F.col("n").cast("string"), F.lit(" 条动态，重点包括："), F.array_join("t", "、"), F.lit("。"))
    return out.select("category", "n", F.when(F.size("a") > 0, F.array_join("a", "；")).otherwise(text).alias("summary"))


def top_summary(top: DataFrame, total: DataFrame) -> DataFrame:
    """One row (summary) of a week's top items (rank, title, ai_note) and its total (n): notes without their last marks if there are two, or else a sentence."""
    rows = top.withColumn("__n", F.col("rank"))
    noted = F.coalesce("ai_note", F.lit("")) != ""
    one = rows.agg(F.count(F.lit(1)).alias("k"), _firsts("title", 3).alias("t"), _firsts("ai_note", 3, noted).alias("a")).join(total)
    bare = F.transform("a", lambda x: F.regexp_replace(x, "[。；！？.;!?]+$", ""))
    text = F.concat(F.lit("本周共收录 "), F.col("n").cast("string"), F.lit(" 条资讯，热度最高的包括「"), F.array_join("t", "」「"), F.lit("」。"))
    return one.select(F.when(F.size("a") >= 2, F.concat(F.array_join(bare, "；"), F.lit("。"))).when(F.col("k") > 0, text).otherwise("").alias("summary"))


def with_insight(reports: DataFrame, insights: DataFrame) -> DataFrame:
    """Weekly reports (week) with the insight whose label begins with their week; the last of several labels, empty ones aside."""
    some = insights.where("insight <> ''").groupBy(F.substring("label", 1, 10).alias("week")).agg(F.max_by("insight", "label").alias("insight"))
    return reports.join(some, "week", "left")


def poster_picks(items: DataFrame, today: str, n: int = 5, least: int = 3) -> DataFrame:
    """The hottest selected items of today, of all items if today has fewer than three; repositories left out."""
    new = F.substring(F.coalesce("first_seen", F.lit("")), 1, 10) == today
    enough = F.broadcast(items.agg((F.count_if(new) >= least).alias("__enough")))  # one row
    some = items.withColumn("__new", new).join(enough).where("__new or not __enough").drop("__new", "__enough")
    news = selected(some).where(~F.coalesce(F.col("origin") == "github", F.lit(False)))
    return news.orderBy(F.coalesce("heat", F.lit(0)).desc(), "id").limit(n)


def poster_sections(items: DataFrame, today: str, categories: list[str], least: int = 3) -> DataFrame:
    """(place, category, items) of the pool that poster_picks takes from: the ids of each category by heat, empty ones too.

    A section is what a picture shows; its length is that of the category in a day's items or, on a thin day, in all.
    """
    new = F.substring(F.coalesce("first_seen", F.lit("")), 1, 10) == today
    enough = F.broadcast(items.agg((F.count_if(new) >= least).alias("__enough")))  # one row
    some = items.withColumn("__new", new).join(enough).where("__new or not __enough").where(F.col("category").isin(categories))
    each = some.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("heat", F.lit(0))).alias("h"), "id"))), lambda x: x["id"]).alias("items"))
    axis = items.sparkSession.createDataFrame(list(enumerate(categories)), "place long, category string")
    none = F.array().cast(f"array<{items.schema['id'].dataType.simpleString()}>")
    return axis.join(each, "category", "left").select("place", "category", F.coalesce("items", none).alias("items"))


def insight_listing(items: DataFrame, start: str, end: str, least: int = 10, most: int = 30) -> DataFrame:
    """One row (n, listing) of a week's items for a prompt: numbered lines of the hottest; no row if there are fewer than `least`."""
    day = F.substring(F.coalesce("published_at", "first_seen", F.lit("")), 1, 10)
    week = items.where(day.between(start, end))
    order = [F.coalesce("heat", F.lit(0)).desc(), F.col("id")]
    top = week.orderBy(*order).limit(most).withColumn("__n", F.row_number().over(Window.orderBy(*order)))  # most rows
    noted = F.when(F.coalesce("ai_note", F.lit("")) != "", F.concat(F.lit(" — "), "ai_note")).otherwise("")
    line = F.concat(F.col("__n").cast("string"), F.lit(". 【"), F.coalesce("source", F.lit("")), F.lit("】"), F.coalesce("title", F.lit("")), noted)
    text = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", line.alias("line")))), lambda x: x["line"]), "\n").alias("listing"))
    return week.agg(F.count(F.lit(1)).alias("n")).join(text).where(F.col("n") >= least)


def weekly_reports(items: DataFrame, today: str, labels: dict[str, str], weeks: int = 6, top: int = 10, per_source: int = 4, per_section: int = 5, sources: int = 8, insights: DataFrame | None = None) -> DataFrame:
    """A row for each of the last weeks up to today's that has items, all of them in one plan.

    week, last (its Monday and Sunday), n, previous (n of the row before), top and sections' items (ids), sources, days and categories (with
    counts, days and categories without items too), a summary of the top and of each section, and insight where insights
    (label, insight) are given.  A week's items are those published in it, or else first seen; order is by heat, then id.
    """
    monday = lambda c: F.date_format(F.date_trunc("week", c), "yyyy-MM-dd")
    day = F.substring(F.coalesce("published_at", "first_seen", F.lit("")), 1, 10)
    dated = items.withColumn("day", day).where(F.col("day").rlike("^\\d{4}-\\d{2}-\\d{2}$"))
    first = F.date_format(F.date_sub(F.date_trunc("week", F.lit(today).cast("date")), 7 * (weeks - 1)), "yyyy-MM-dd")
    last = F.date_format(F.date_add(F.date_trunc("week", F.lit(today).cast("date")), 6), "yyyy-MM-dd")
    rows = dated.where(F.col("day").between(first, last)).withColumn("week", monday(F.col("day").cast("date")))
    if "ai_note" not in rows.columns:
        rows = rows.withColumn("ai_note", F.lit(None).cast("string"))
    rows = rows.select("id", "week", "day", "source", "category", "title", F.nullif("ai_note", F.lit("")).alias("ai_note"), F.coalesce("heat", F.lit(0)).alias("heat"))
    counts = rows.groupBy("week", "day", "source", "category").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("heat"), F.col("id")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy("week", *keys).orderBy(*order))
    values = lambda column, keep=None: F.transform(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull() if keep is None else keep, F.struct("k", F.col(column).alias("v"))))), lambda x: x["v"])
    # the top, at most so many of a source
    best = rows.withColumn("k", rank("source")).where(F.col("k") <= per_source).withColumn("k", rank()).where(F.col("k") <= top)
    best = best.groupBy("week").agg(values("id").alias("top"), values("title").alias("titles"), values("ai_note", F.col("ai_note").isNotNull()).alias("notes"))
    # sections: their first items, and the first notes, which may be of later ones
    ranked = rows.withColumn("k", rank("category")).where(F.col("k") <= per_section)
    heads = ranked.groupBy("week", "category").agg(values("id").alias("items"), values("title").alias("titles"))
    noted = rows.where("ai_note is not null").withColumn("k", rank("category")).where("k <= 2").groupBy("week", "category").agg(values("ai_note").alias("notes"))
    per = counts.groupBy("week", "category").agg(F.sum("n").alias("n")).join(heads, ["week", "category"]).join(noted, ["week", "category"], "left")
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in labels.items() for x in p)), F.col("category")), F.col("category"))
    text = F.concat(F.lit("本周"), label, F.lit("方向共 "), F.col("n").cast("string"), F.lit(" 条动态，重点包括："), F.array_join(F.slice("titles", 1, 3), "、"), F.lit("。"))
    per = per.select("week", "category", "n", F.struct("items", F.when(F.size("notes") > 0, F.array_join("notes", "；")).otherwise(text).alias("summary")).alias("section"))
    none = F.struct(F.array().cast(f"array<{items.schema['id'].dataType.simpleString()}>").alias("items"), F.lit("").alias("summary"))
    of = lambda column, key, otherwise: F.coalesce(F.try_element_at(F.map_from_entries(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", column)))), F.lit(key)), otherwise)
    sections = per.groupBy("week").agg(
        F.array(*(F.struct(F.lit(c).alias("category"), of("section", c, none).alias("section")) for c in labels)).alias("sections"),
        F.array(*(F.struct(F.lit(c).alias("category"), of("n", c, F.lit(0).cast("long")).alias("n")) for c in labels)).alias("categories"),
    )
    each = counts.groupBy("week", "source").agg(F.sum("n").alias("n"))
    each = each.withColumn("k", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("n"), "source"))).where(F.col("k") <= sources)
    each = each.groupBy("week").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "source", "n"))), lambda x: F.struct(x["source"].alias("source"), x["n"].alias("n"))).alias("sources"))
    daily = counts.groupBy("week", "day").agg(F.sum("n").alias("n")).groupBy("week").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias("by_day"))
    axis = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.date_format(F.date_add(F.col("week").cast("date"), k), "yyyy-MM-dd"))
    daily = daily.withColumn("days", F.transform(axis, lambda d: F.struct(d.alias("day"), F.coalesce(F.try_element_at("by_day", d), F.lit(0)).alias("n"))))
    out = daily.join(best, "week").join(sections, "week").join(each, "week")  # a row for each week
    bare = F.transform(F.slice("notes", 1, 3), lambda x: F.regexp_replace(x, "[。；！？.;!?]+$", ""))
    short = F.concat(F.lit("本周共收录 "), F.col("n").cast("string"), F.lit(" 条资讯，热度最高的包括「"), F.array_join(F.slice("titles", 1, 3), "」「"), F.lit("」。"))
    summary = F.when(F.size("notes") >= 2, F.concat(F.array_join(bare, "；"), F.lit("。"))).otherwise(short)
    before = F.lag("n").over(Window.orderBy("week"))
    out = out.select("week", F.date_format(F.date_add(F.col("week").cast("date"), 6), "yyyy-MM-dd").alias("last"), "n", before.alias("previous"), "top", "sections", "sources", "days", "categories", summary.alias("summary"))
    return with_insight(out, insights) if insights is not None else out


def palette(query: str, categories: DataFrame, sources: DataFrame, found: DataFrame, most: int = 14) -> DataFrame:
    """(kind, id, label) of the command palette: categories (key, label), the daily page, at most eight sources (source, n), then found items (id, title, score).

    Categories, page and sources contain the query; without one all categories and six sources are shown, and no items.
    """
    q = query.strip().lower()
    named = lambda c: F.contains(F.lower(c), F.lit(q))
    spark = categories.sparkSession
    parts = [categories.where(named("label")).select(F.lit(0).alias("o"), F.monotonically_increasing_id().cast("double").alias("r"), F.lit("category").alias("kind"), F.col("key").alias("id"), "label")]
    if not q or q in "日报" or q in "daily":
        parts.append(spark.range(1).select(F.lit(1).alias("o"), F.lit(0.0).alias("r"), F.lit("page").alias("kind"), F.lit("daily").alias("id"), F.lit("今日 AI 资讯日报").alias("label")))
    some = sources.where(named("source")).orderBy(F.desc("n"), "source").limit(8 if q else 6)
    parts.append(some.select(F.lit(2).alias("o"), (-F.col("n")).cast("double").alias("r"), F.lit("source").alias("kind"), F.col("source").alias("id"), F.col("source").alias("label")))
    if q:
        hits = found.orderBy(F.desc("score"), "id").limit(8)
        parts.append(hits.select(F.lit(3).alias("o"), (-F.col("score")).cast("double").alias("r"), F.lit("item").alias("kind"), F.col("id").cast("string").alias("id"), F.col("title").alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("o", "r", "id").limit(most).select("kind", "id", "label")
