"""The repository board: gains by period, momentum, breakouts, shares of tracks, and the state that is carried between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import half_up

# Days of the periods, in the order in which a gain is quoted, and the thresholds of the board.
DAYS = {"daily": 1, "weekly": 7, "monthly": 30}
QUOTED = ("weekly", "daily", "monthly")
LEAST_PACE, RISING, FALLING, BREAKOUT = 20, 1.5, 0.6, 1.8
LEAST_STARS, HISTORY, SPAM_LENGTH = 50, 60, 300
#: Pages of which so many rows lack stars are not to be trusted.
GUARD_ROWS, GUARD_SHARE = 20, 0.5


def gains(stars: DataFrame, now: Column, totals: DataFrame | None = None, at: str = "at") -> DataFrame:
    """(repo, daily, weekly, monthly, stars) of star events (repo, at): events since each window's start.

    A window is null unless the events cover it: where the oldest one known is older, or where totals (repo, stars) says that all are known.
    """
    age = lambda days: now - F.make_dt_interval(F.lit(days))
    out = stars.groupBy("repo").agg(*(F.count_if(F.col(at) >= age(d)).alias(p) for p, d in DAYS.items()), F.count(F.lit(1)).alias("known"), F.min(at).alias("oldest"), F.max(now).alias("now"))
    out = out.join(totals, "repo", "left") if totals is not None else out.withColumn("stars", F.col("known"))
    every = F.col("known") >= F.coalesce("stars", F.col("known"))
    covered = lambda d: every | (F.col("oldest") < F.col("now") - F.make_dt_interval(F.lit(d)))
    return out.select("repo", *(F.when(covered(d), F.col(p)).alias(p) for p, d in DAYS.items()), F.coalesce("stars", "known").alias("stars"))


def paces(repos: DataFrame) -> DataFrame:
    """Gains a day of each period: pace_daily, pace_weekly, pace_monthly."""
    return repos.withColumns({f"pace_{p}": F.col(p) / float(d) for p, d in DAYS.items()})


def with_momentum(repos: DataFrame) -> DataFrame:
    """repos (daily, weekly, monthly) with momentum: "up" above one and a half times the week's pace, "down" below 0.6 of it, else null.

    Both gains must be known and the week's pace be 20 a day.
    """
    d, w = F.col("daily").cast("double"), F.col("weekly") / 7.0
    return repos.withColumn("momentum", F.when(w < LEAST_PACE, None).when(d > w * RISING, "up").when(d < w * FALLING, "down"))


def hot(repos: DataFrame) -> Column:
    """The week's gain, three times the day's and a quarter of the month's."""
    g = lambda p: F.coalesce(p, F.lit(0))
    return g("weekly") + g("daily") * 3 + g("monthly") / 4.0


def best_gain() -> Column:
    """(period, n): the first period of growth, or else the first that is known; null if none is."""
    some = [F.when(F.col(p) > 0, F.struct(F.lit(p).alias("period"), F.col(p).cast("long").alias("n"))) for p in QUOTED]
    known = [F.when(F.col(p).isNotNull(), F.struct(F.lit(p).alias("period"), F.col(p).cast("long").alias("n"))) for p in QUOTED]
    return F.coalesce(*some, *known)


def gain_of(period: str) -> Column:
    """The gain of a period if there is any, or else the best one."""
    return F.coalesce(F.when(F.col(period) > 0, F.struct(F.lit(period).alias("period"), F.col(period).cast("long").alias("n"))), best_gain())


def in_period(repos: DataFrame, period: str) -> DataFrame:
    """Repositories that grew in a period."""
    return repos.where(F.coalesce(F.col(period), F.lit(0)) > 0)


def in_tab(repos: DataFrame, tab: str) -> DataFrame:
    """Repositories of a tab: all, the playful ones, or a track."""
    return repos if tab == "all" else repos.where("fun is not null") if tab == "fun" else repos.where(F.col("track") == tab)


def breakouts(repos: DataFrame) -> DataFrame:
    """Trending repositories whose day is 1.8 times their week's pace or who aren't on the week's list, by the day's gain.

    sources is an array of where a repository was found.  A week without gain makes any day a breakout.
    """
    pace = F.col("weekly") / 7.0
    fast = F.col("weekly").isNull() | (F.col("weekly") == 0) | (F.col("daily") / F.nullif(pace, F.lit(0.0)) >= BREAKOUT)
    return repos.where(F.col("daily").isNotNull() & F.array_contains("sources", "trending") & F.coalesce(fast, F.lit(False)))


def track_stats(repos: DataFrame, period: str) -> DataFrame:
    """(track, n, gained, share, place) of the tracks in a period: share of the whole gain in per cent, place by gain; the first is the leader."""
    each = in_period(repos, period).groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.sum(period).cast("long").alias("gained"))
    every = Window.partitionBy()  # one row for each track
    return each.select("track", "n", "gained", half_up(F.col("gained") * 100.0 / F.sum("gained").over(every)).alias("share"), F.row_number().over(Window.orderBy(F.desc("gained"), "track")).cast("long").alias("place"))


def source_mix(repos: DataFrame) -> DataFrame:
    """(source, n) of repositories by each source that found them."""
    return repos.select(F.explode(F.array_distinct("sources")).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def tab_counts(repos: DataFrame, period: str) -> DataFrame:
    """(tab, n): how many repositories of a period each tab holds, those of all and of the playful tab too."""
    some = in_period(repos, period)
    both = some.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("fun").isNotNull()).alias("fun"))
    tracks = some.groupBy(F.col("track").alias("tab")).agg(F.count(F.lit(1)).alias("n"))
    return both.select(F.explode(F.create_map(F.lit("all"), "all", F.lit("fun"), "fun")).alias("tab", "n")).unionByName(tracks)


def untracked(found: DataFrame, tracked: DataFrame) -> DataFrame:
    """Search results that aren't tracked yet, without those whose long descriptions are stuffed with words."""
    some = found.where(F.length(F.coalesce("description", F.lit(""))) <= SPAM_LENGTH).withColumn("__key", F.lower("full_name"))
    return some.join(tracked.select(F.lower("full_name").alias("__key")), "__key", "left_anti").drop("__key")


def worth_keeping(repos: DataFrame) -> DataFrame:
    """Trending repositories, and others of fifty stars or more that grew in some period."""
    grew = F.greatest(*(F.coalesce(F.col(p), F.lit(0)) for p in DAYS)) > 0
    return repos.where(F.array_contains("sources", "trending") | ((F.coalesce("stars", F.lit(0)) >= LEAST_STARS) & grew))


def markup_drift(rows: DataFrame) -> DataFrame:
    """One row (rows, without_stars, drifted): whether the parsed rows look as if the pages' markup had changed."""
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce("stars", F.lit(0)) == 0).alias("without_stars"))
    return counts.withColumn("drifted", (F.col("rows") >= GUARD_ROWS) & (F.col("without_stars") > F.col("rows") * GUARD_SHARE))


def merged_periods(rows: DataFrame) -> DataFrame:
    """One row for each repository of trending rows (full_name, period, stars, forks, gained): the largest of each, and a column for each period's gain."""
    gained = (F.max(F.when(F.col("period") == p, F.col("gained"))).alias(p) for p in DAYS)
    return rows.groupBy(F.lower("full_name").alias("key")).agg(F.min("full_name").alias("full_name"), F.max("stars").alias("stars"), F.max("forks").alias("forks"), *gained)


def with_memory(repos: DataFrame, previous: DataFrame) -> DataFrame:
    """repos with what the previous snapshot knew of each: created_at, topics, history and note, where they lack it."""
    kept = ("created_at", "topics", "history", "note")
    old = previous.select(F.lower("full_name").alias("__key"), *(F.col(c).alias(f"__{c}") for c in kept if c in previous.columns))
    out = repos.withColumn("__key", F.lower("full_name")).join(old, "__key", "left")
    filled = {c: F.coalesce(c, f"__{c}") if c in repos.columns else F.col(f"__{c}") for c in kept if c in previous.columns}
    return out.withColumns(filled).drop("__key", *(f"__{c}" for c in kept))


def overlaid(repos: DataFrame, found: DataFrame) -> DataFrame:
    """repos with looked-up metadata (full_name, stars, description, created_at, topics) over them; a trending repository keeps its stars and description."""
    new = found.select(F.lower("full_name").alias("__key"), *(F.col(c).alias(f"__{c}") for c in ("stars", "description", "created_at", "topics")))
    out = repos.withColumn("__key", F.lower("full_name")).join(new, "__key", "left")
    own = F.array_contains("sources", "trending")
    mixed = {c: F.when(own, F.coalesce(c, f"__{c}")).otherwise(F.coalesce(f"__{c}", c)) for c in ("stars", "description")}
    return out.withColumns({**mixed, "created_at": F.coalesce("__created_at", "created_at"), "topics": F.coalesce("__topics", "topics")}).drop("__key", "__stars", "__description", "__created_at", "__topics")


def with_colours(repos: DataFrame) -> DataFrame:
    """repos whose missing language_color is filled from others of the same language."""
    dim = repos.where("language is not null and language_color is not null").groupBy(F.col("language").alias("__l")).agg(F.min("language_color").alias("__c"))
    return repos.join(dim, F.col("language") == F.col("__l"), "left").withColumn("language_color", F.coalesce("language_color", "__c")).drop("__l", "__c")


def gained_since_creation(repos: DataFrame, age_days: Column) -> DataFrame:
    """repos with the gain of each period that began before they were created: all their stars."""
    return repos.withColumns({p: F.when(F.col(p).isNull() & (age_days <= d), F.col("stars")).otherwise(F.col(p)) for p, d in DAYS.items()})


def histories(samples: DataFrame, most: int = HISTORY) -> DataFrame:
    """(repo, history): the last `most` samples (repo, date, stars), one for each date, the greatest of a date's."""
    each = samples.groupBy("repo", "date").agg(F.max("stars").alias("stars"))
    last = Window.partitionBy("repo").orderBy(F.desc("date"))
    some = each.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= most)
    return some.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("date", "stars"))).alias("history"))
