"""Repositories: trend badges on items, mentions in the news, merged candidates, histories, and the trending page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import clean_html


def plain_url(c: Column) -> Column:
    """Lower case, without query, fragment and last slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[#?].*$", ""), "/+$", "")


def badge(gained: dict[str, str]) -> Column:
    """The period whose gain is defined, the week before the day before the month, and its gain."""
    names = ["weekly", "daily", "monthly"]
    period = F.coalesce(*(F.when(F.col(gained[n]).isNotNull(), n) for n in names))
    return F.struct(period.alias("period"), F.coalesce(*(F.col(gained[n]) for n in names)).alias("gained"))


def with_trend(items: DataFrame, repos: DataFrame, news: DataFrame) -> DataFrame:
    """items with repo, period and gained: of the repository at the item's URL (the last of several), or else of the first whose news has its id.

    repos: full_name, url, ord, weekly, daily, monthly; news: full_name, ord, id.  A gain of 0 is no badge.
    """
    marked = repos.withColumn("b", badge({n: n for n in ("weekly", "daily", "monthly")}))
    by_url = marked.groupBy(F.lower("url").alias("__url")).agg(F.max_by(F.struct("full_name", "b"), "ord").alias("u"))
    first = news.groupBy("id").agg(F.min_by("full_name", "ord").alias("full_name"))
    by_news = first.join(marked.select("full_name", "b"), "full_name").select("id", F.struct("full_name", "b").alias("w"))
    both = items.withColumn("__url", plain_url(F.col("source_url"))).join(by_url, "__url", "left").join(by_news, "id", "left")
    hit = F.coalesce("u", "w")
    good = hit["b"]["gained"] > 0
    return both.withColumns({"repo": F.when(good, hit["full_name"]), "period": F.when(good, hit["b"]["period"]), "gained": F.when(good, hit["b"]["gained"])}).drop("__url", "u", "w")


def mentioned(items: DataFrame, repos: DataFrame, days: int, now: str, most: int = 5) -> DataFrame:
    """(repo, id, rank): the newest items of the last days whose title has a repository's name as a token.

    A join by token; each repository keeps `most` items.
    """
    recent = items.where(F.try_to_timestamp("published_at") >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {days} days"))
    words = recent.select("id", "published_at", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9][a-z0-9_.-]*"), F.lit(0)))).alias("token"))
    met = words.join(repos.select(F.col("full_name").alias("repo"), F.lower("name").alias("token")), "token")
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("published_at"), "id"))
    return met.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("repo", "id", "rank")


def merged_candidates(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row for each name over candidate tables (full_name, stars, description): the earliest table's values and all tables' names."""
    rows = None
    for k, (name, frame) in enumerate(sources):
        part = frame.select(F.lower("full_name").alias("key"), "full_name", "stars", "description", F.lit(name).alias("source"), F.lit(k).alias("k"))
        rows = part if rows is None else rows.unionByName(part)
    first = lambda c: F.min_by(c, "k").alias(c)
    return rows.groupBy("key").agg(first("full_name"), first("stars"), first("description"), F.array_sort(F.collect_set("source")).alias("sources")).drop("key")


def appended(history: Column, today: Column, value: Column, most: int = 60) -> Column:
    """A history array of (date, stars) with today's sample in place of an earlier one of today, its last `most` entries."""
    every = F.concat(F.filter(F.coalesce(history, F.array()), lambda s: s["date"] != today), F.array(F.struct(today.alias("date"), value.alias("stars"))))
    return F.slice(every, F.greatest(F.size(every) - most + 1, F.lit(1)), F.lit(most))


def trending_rows(pages: DataFrame) -> DataFrame:
    """(full_name, description, language, language_color, stars, forks, gained, built_by) of the boxes of trending pages (html).

    A box without a name is left out; numbers that it lacks are 0, texts null; built_by has at most five (login, avatar).
    """
    # How the page marks its boxes and their fields.
    boxes = pages.select(F.explode(F.slice(F.split("html", '<article class="Box-row'), 2, 1 << 20)).alias("box")).select(F.get(F.split("box", "</article>"), F.lit(0)).alias("box"))
    rows = boxes.withColumn("full_name", F.regexp_extract("box", '<h2[^>]*>\\s*<a[^>]*href="/([^/"]+/[^/"]+)"', 1)).where("full_name <> ''")

    def number(c: Column) -> Column:
        return F.coalesce(F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).try_cast("long"), F.lit(0))

    def linked(page: str) -> Column:
        """The number after the repository's own link to a page."""
        name = F.regexp_replace("full_name", r"([.*+?^${}()|\[\]\\])", r"\\$1")
        pattern = F.concat(F.lit('href="/'), name, F.lit(f'/{page}"[\\s\\S]*?</svg>\\s*([0-9,]+)'))
        return number(F.call_function("regexp_extract", F.col("box"), pattern, F.lit(1)))

    found = lambda p: F.nullif(F.trim(F.regexp_extract("box", p, 1)), F.lit(""))
    picture = '<img class="avatar[^"]*" src="([^"]+)"[^>]*alt="@([^"]+)"'
    makers = F.slice(F.arrays_zip(F.regexp_extract_all("box", F.lit(picture), F.lit(2)).alias("login"), F.transform(F.regexp_extract_all("box", F.lit(picture), F.lit(1)), lambda a: F.replace(a, F.lit("&amp;"), F.lit("&"))).alias("avatar")), 1, 5)
    return rows.select(
        "full_name",
        F.nullif(clean_html(F.regexp_extract("box", '<p class="col-9[^"]*">([\\s\\S]*?)</p>', 1)), F.lit("")).alias("description"),
        found('itemprop="programmingLanguage">([^<]+)<').alias("language"),
        found("repo-language-color\" style=\"background-color:\\s*(#[0-9a-fA-F]{3,8})").alias("language_color"),
        linked("stargazers").alias("stars"),
        linked("forks").alias("forks"),
        number(F.regexp_extract("box", "([0-9,]+)\\s+stars?\\s+(?:today|this week|this month)", 1)).alias("gained"),
        makers.alias("built_by"),
    )
