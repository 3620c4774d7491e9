"""Merges with earlier snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_history(items: DataFrame, previous: DataFrame, now: str) -> DataFrame:
    """items with first_seen of the previous snapshot, or now for new ones, and the note that it had; what an item has itself goes first."""
    noted = "ai_note" in previous.columns
    old = previous.select("id", F.col("first_seen").alias("__first"), *([F.col("ai_note").alias("__note")] if noted else []))
    own = lambda c: [c] if c in items.columns else []
    out = items.join(old, "id", "left").withColumn("first_seen", F.coalesce(*own("first_seen"), "__first", F.lit(now)))
    if noted:
        out = out.withColumn("ai_note", F.coalesce(*own("ai_note"), "__note"))
    return out.drop("__first", "__note")


def pool(current: DataFrame, archive: DataFrame) -> DataFrame:
    """Current items and those of the archive that aren't among them, one row for each id."""
    first = archive.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("published_at")))).where("__n = 1").drop("__n")
    return current.unionByName(first.join(current.select("id"), "id", "left_anti"), allowMissingColumns=True)


def carried_over(current: DataFrame, previous: DataFrame, outage: list[str]) -> DataFrame:
    """current with the previous rows of sources that failed and aren't there yet."""
    old = previous.where(F.col("source").isin(outage)).join(current.select("id"), "id", "left_anti")
    return current.unionByName(old, allowMissingColumns=True)


def sanitised_conversations(turns: DataFrame, most: int = 8) -> DataFrame:
    """(conv_id, n) of conversations of one to eight messages, all with a known role and some text."""
    ok = F.col("role").isin("system", "user", "assistant") & F.col("text").isNotNull()
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok")).where((F.col("n") <= most) & F.col("ok")).select("conv_id", "n")


def first_wins(*pools: DataFrame) -> DataFrame:
    """The union of pools, one row for each id: that of the first pool, and there of the least row hash."""
    return _one_each(pools, ascending=True)


def last_wins(*pools: DataFrame) -> DataFrame:
    """The union of pools, one row for each id: that of the last pool."""
    return _one_each(pools, ascending=False)


def _one_each(pools: tuple[DataFrame, ...], ascending: bool) -> DataFrame:
    every = None
    for k, p in enumerate(pools):
        part = p.withColumn("__k", F.lit(k if ascending else -k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    order = Window.partitionBy("id").orderBy("__k", F.xxhash64(*[c for c in pools[0].columns]))
    return every.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__k")


def either(first: DataFrame, other: DataFrame) -> DataFrame:
    """The first table if it has rows, else the other."""
    some = F.broadcast(first.agg((F.count(F.lit(1)) > 0).alias("__some")))  # one row
    return first.unionByName(other.join(some).where(~F.col("__some")).drop("__some"), allowMissingColumns=True)


def to_enrich(items: DataFrame, column: str, order: list, budget: int) -> DataFrame:
    """The first rows in an order that lack a value of a column, as many as the budget allows."""
    return items.where(F.coalesce(column, F.lit("")) == "").orderBy(*order).limit(budget)
