"""Counts and rankings over days, weeks and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_counts(items: DataFrame, categories: list[str], day: Column) -> DataFrame:
    """Per day the number of items, in all and of each category."""
    each = [F.count_if(F.col("category") == c).alias(f"n_{c}") for c in categories]
    return items.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("total"), *each).where("day <> ''")


def topic_trends(items: DataFrame, topic: str, day: Column, top: int = 8) -> DataFrame:
    """(topic, day, n, total) of the topics with the most items."""
    each = items.groupBy(F.col(topic).alias("topic"), day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    totals = each.groupBy("topic").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "topic").limit(top)
    return each.join(F.broadcast(totals), "topic")  # at most `top` rows


def densified(series: DataFrame, days: DataFrame) -> DataFrame:
    """(topic, day, n) of every topic on every day, with 0 where it has none."""
    axis = days.select("day").distinct().agg(F.collect_set("day").alias("days"))
    grid = series.select("topic").distinct().join(F.broadcast(axis)).select("topic", F.explode("days").alias("day"))
    return grid.join(series, ["topic", "day"], "left").select("topic", "day", F.coalesce("n", F.lit(0)).alias("n"))


def top_per(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank; Spark prunes each partition to n rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def latest_days(items: DataFrame, day: Column, days: int) -> DataFrame:
    """Items of the latest days that have any."""
    keyed = items.withColumn("day", day).where("day <> ''")
    return keyed.join(F.broadcast(keyed.select("day").distinct().orderBy(F.desc("day")).limit(days)), "day")


def capped_top(rows: DataFrame, cap: int, n: int, order: list[Column]) -> DataFrame:
    """The first n rows when each source gives at most cap."""
    some = top_per(rows, ["source"], order, cap).drop("rank").orderBy(*order).limit(n)
    return some.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def week(day: Column) -> Column:
    """The Monday of a day."""
    return F.date_format(F.date_trunc("week", F.to_date(day)), "yyyy-MM-dd")


def week_over_week(items: DataFrame, day: Column) -> DataFrame:
    """(week, total, previous, change) over the weeks that have items."""
    totals = items.groupBy(week(day).alias("week")).agg(F.count(F.lit(1)).alias("total"))
    before = F.lag("total").over(Window.orderBy("week"))
    return totals.select("week", "total", before.alias("previous"), (F.col("total") - before).alias("change"))


def streaks(days: DataFrame, key: str) -> DataFrame:
    """(key, streak): the length of the run of consecutive days that ends at each key's last day."""
    rows = days.select(key, "day").distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    runs = rows.withColumn("island", island).groupBy(key, "island").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last"))
    return runs.groupBy(key).agg(F.max_by("n", "last").alias("streak"))


def gains(stars: DataFrame, now: Column, windows: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Stars of each repo in the last days up to now."""
    return stars.groupBy("repo").agg(*(F.count_if(F.col("day") > F.date_sub(now, w)).alias(f"gain_{w}") for w in windows), F.count(F.lit(1)).alias("stars"))


def momentum(gained: DataFrame) -> DataFrame:
    """hot score (week + 3 days' + a quarter of the month's gain) and direction of repos with gains; null below a pace of 20 a day, or between up and down."""
    d, w, m = F.col("gain_1") / 1.0, F.col("gain_7") / 7.0, F.col("gain_30")
    way = F.when(w < 20, None).when(d > 1.5 * w, "up").when(d < 0.6 * w, "down")
    return gained.withColumn("hot", F.col("gain_7") + 3 * F.col("gain_1") + m / 4.0).withColumn("direction", way)


def first_of_kind(rows: DataFrame, kind: str, order: list[Column], n: int = 6) -> DataFrame:
    """The first row of each kind in order, then the rest in order, n in all."""
    turn = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    out = rows.withColumn("later", (turn > 1).cast("int")).orderBy("later", *order).limit(n)
    return out.withColumn("place", F.row_number().over(Window.orderBy("later", *order)).cast("long")).drop("later")


def nearest_sample(history: DataFrame, key: str, today: Column, days: int) -> DataFrame:
    """The first sample of each key within a day of `days` before today."""
    gap = F.abs(F.datediff("day", F.date_sub(today, days)))
    return history.where(gap <= 1).groupBy(key).agg(F.min_by(F.struct("day", "value"), "day").alias("s")).select(key, "s.day", "s.value")
