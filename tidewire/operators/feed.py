"""Feed queries: filters, orders, pages and personal views."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class FeedQuery:
    """What a reader asks for.  since is "7d", "24h", a date prefix, or empty."""

    mode: str = "selected"
    category: str = "all"
    sources: list[str] = field(default_factory=list)
    keyword: str = ""
    since: str = ""
    now: str = ""


def since_time(since: str, now: str) -> Column | None:
    import re

    if m := re.fullmatch(r"(\d+)([dh])", since):
        return F.to_timestamp(F.lit(now)) - F.expr(f"interval {m[1]} {'days' if m[2] == 'd' else 'hours'}")
    return F.to_timestamp(F.lit(since)) if re.match(r"\d{4}-\d{2}-\d{2}", since) else None


def filtered(items: DataFrame, q: FeedQuery) -> DataFrame:
    """Items that a query keeps.  Unlabelled items count as selected; a time window needs published_at."""
    if q.mode == "selected":
        items = items.where(~F.col("ai_selected").eqNullSafe(False))
    if q.category != "all":
        items = items.where(F.col("category") == q.category)
    if wanted := [s.strip() for s in q.sources if s.strip()]:
        items = items.where(F.col("source").isin(wanted))
    if word := q.keyword.strip().lower():
        fields = [c for c in ("title", "summary", "source") if c in items.columns]
        hit = F.lit(False)
        for c in fields:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(word)), F.lit(False))
        if "tags" in items.columns:
            hit = hit | F.coalesce(F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(word))), F.lit(False))
        items = items.where(hit)
    if (least := since_time(q.since, q.now)) is not None:
        items = items.where(F.try_to_timestamp("published_at") >= least)
    return items


def latest_first(*fallbacks: str) -> list[Column]:
    """By published_at, or else by fallbacks such as first_seen."""
    return [F.coalesce("published_at", *fallbacks, F.lit("")).desc(), F.col("id")]


def hottest_first(*more: Column) -> list[Column]:
    return [F.coalesce("heat", F.lit(0)).desc(), *more, F.col("id")]


def page(items: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page, with the number clamped to the pages there are: page, total, total_pages come along.

    Sorted by ranges; only rows up to the end of the page are ranked.
    """
    total = items.agg(F.count(F.lit(1)).alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    total = total.select("total", pages.alias("total_pages")).withColumn("page", F.least(F.lit(max(1, number)).cast("long"), "total_pages"))
    # as many rows as the page's end, or, where there are fewer pages, all that there are up to it
    rows = items.orderBy(*order).limit(max(1, number) * size)
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).join(F.broadcast(total))  # one row
    return ranked.where((F.col("rank") > (F.col("page") - 1) * size) & (F.col("rank") <= F.col("page") * size))


def personalised(items: DataFrame, muted: list[str], sources: list[str], categories: list[str]) -> DataFrame:
    """Items without muted sources, and whether a followed source or category puts them first."""
    out = items.where(~F.col("source").isin(muted)) if muted else items
    return out.withColumn("followed", F.col("source").isin(sources) | F.coalesce(F.col("category").isin(categories), F.lit(False)))


def floated(items: DataFrame, order: list[Column]) -> DataFrame:
    """Personalised items with the followed ones first, each part in the given order."""
    return items.orderBy(F.desc("followed"), *order)
