"""Removal of repeated items by URL, title and likeness."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import jaccard, title_key, url_key
from tidewire.lineage import cut
from tidewire.operators.stories import components

LIKENESS, LATIN, LEAST_TOKENS, NEAR_HOURS = 0.65, 0.5, 4, 72


def richness(rows: DataFrame) -> Column:
    """2 for a summary, a half for selection and a millionth of the engagement, or else of the heat."""
    known = F.coalesce(*(c for c in ("engagement", "heat") if c in rows.columns), F.lit(0))
    return F.when(F.coalesce(F.length("summary"), F.lit(0)) > 0, 2.0).otherwise(0.0) + F.when(F.col("ai_selected"), 0.5).otherwise(0.0) + known * 1e-6


def best_by(rows: DataFrame, key: Column, score: Column, ord: str = "id") -> DataFrame:
    """The best row of each key, earlier ones first among equals, with the least ord (unique) of its key as place.

    Only keys, scores and ords are grouped, and reduced before that; rows meet the chosen ords afterwards.
    """
    keyed = rows.select(key.alias("__k"), score.alias("__s"), F.col(ord).alias("__o"))
    kept = keyed.groupBy("__k").agg(F.min_by("__o", F.struct(-F.col("__s"), "__o")).alias(ord), F.min("__o").alias("place"))
    return rows.join(kept.drop("__k"), ord).select(*rows.columns, "place")


def by_url(rows: DataFrame) -> DataFrame:
    """The best row of each URL; rows without a URL are left out."""
    some = rows.where(F.coalesce("source_url", F.lit("")) != "")
    return best_by(some, url_key(F.col("source_url")), richness(some))


def by_title(rows: DataFrame) -> DataFrame:
    """Titles of eight or more characters after normalisation are keys; others are their own."""
    key = title_key(F.col("title"))
    return best_by(rows, F.when(F.length(key) >= 8, F.concat(F.lit("t:"), key)).otherwise(F.concat(F.lit("i:"), F.col("id").cast("string"))), richness(rows))


def near_tokens(c: Column) -> Column:
    """Distinct ASCII words of three or more characters, CJK characters that stand alone, and pairs of neighbouring ones, in order."""
    low = F.lower(c)
    runs = F.regexp_extract_all(low, F.lit("[\\x{2E80}-\\x{9FFF}]+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: r.substr(i, F.lit(2)))))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9][a-z0-9.-]{2,}"), F.lit(0)), F.flatten(pairs))))


def _like(x: set, y: set) -> bool:
    both = len(x & y)
    if both / (len(x) + len(y) - both) < LIKENESS:
        return False
    p, q = ({t for t in z if t[0] in "abcdefghijklmnopqrstuvwxyz0123456789"} for z in (x, y))
    return len(p & q) / min(len(p), len(q)) >= LATIN if p and q else not p and not q


def _collapsed(table: pa.Table) -> pa.Table:
    """The ids that go, of items that may be like each other: each meets the kept ones in order, and of two alike the better stays."""
    kept, gone = [], []
    for r in sorted(table.to_pylist(), key=lambda r: r["ord"]):
        tokens = set(r["tokens"])
        for k in kept:
            if (r["time"] and k["time"] and abs(r["time"] - k["time"]) > NEAR_HOURS * 3_600_000) or not _like(tokens, k["tokens"]):
                continue
            if r["score"] > k["score"]:
                gone.append(k["id"])
                k.update(r, tokens=tokens)
            else:
                gone.append(r["id"])
            break
        else:
            kept.append(r | {"tokens": tokens})
    return pa.table({"id": pa.array(gone, table.schema.field("id").type)})


def like_sets(sets: DataFrame) -> DataFrame:
    """(a, b) of token sets (unique set, tokens) with a Jaccard of 0.65, as many as connect whatever such pairs connect.

    Sets meet by the rarest tokens that sets so alike must share, where the tokens from there on can suffice.  First each meets the least set
    and its neighbour in size at a token; then only those that aren't connected yet meet, so that a crowd of copies makes no pairs.
    """
    sets = cut(sets)
    each = sets.select("set", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    ranked = each.join(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "token", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("set").orderBy("df", "token"))
    some = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * LIKENESS - 1e-9) + 1).where("df > 1")
    some = cut(some.select("token", F.struct("n", "set", "place").alias("at")))

    def can(a: Column, b: Column) -> Column:
        """Whether a, the smaller, and b can be alike if this token is the first that they share."""
        shared = 1 + F.least(a["n"] - a["place"], b["n"] - b["place"])
        return (a["n"] >= b["n"] * LIKENESS - 1e-9) & (shared >= (a["n"] + b["n"]) * (LIKENESS / (1 + LIKENESS)) - 1e-9)

    def alike(met: DataFrame) -> DataFrame:
        met = met.distinct().join(sets.select(F.col("set").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("tokens").alias("y")), "b")
        return cut(met.where(jaccard(F.col("x"), F.col("y")) >= LIKENESS).select("a", "b"))

    by_size = Window.partitionBy("token").orderBy("at")
    near = some.select("at", F.first("at").over(by_size).alias("least"), F.lag("at").over(by_size).alias("last"))
    near = near.select("at", F.explode(F.array("least", "last")).alias("less"))
    first = alike(near.where("less.set <> at.set").where(can(F.col("less"), F.col("at"))).select(F.col("less.set").alias("a"), F.col("at.set").alias("b")))
    parts = components(first).select(F.col("id").alias("set"), "story")
    placed = some.join(parts, some["at.set"] == parts["set"], "left").select("token", "at", F.coalesce("story", "at.set").alias("story"))
    # the smaller of two sets shares even more of its tokens
    short = placed.where(F.col("at.place") <= F.col("at.n") - F.ceil(F.col("at.n") * (2 * LIKENESS / (1 + LIKENESS)) - 1e-9) + 1)
    x, y = (t.select("token", F.col("at").alias(c), F.col("story").alias(f"story_{c}")) for t, c in ((short, "p"), (placed, "q")))
    less = (F.col("p.n") < F.col("q.n")) | ((F.col("p.n") == F.col("q.n")) & (F.col("p.set") < F.col("q.set")))
    met = x.join(y, "token").where(less & (F.col("story_p") != F.col("story_q")) & can(F.col("p"), F.col("q")))
    return first.unionByName(alike(met.select(F.col("p.set").alias("a"), F.col("q.set").alias("b"))))


def collapse_near_dups(items: DataFrame, ord: str = "id") -> DataFrame:
    """Items (unique id) without near copies: token Jaccard 0.65, within 72 hours where both times are known, four tokens, and half of the Latin tokens.

    Items come in the order of ord.  Each component of like sets is gone through in order, stretch by stretch of time: items of different ones are never alike.
    """
    score = richness(items)
    time = F.coalesce(F.unix_millis(F.try_to_timestamp("published_at")), F.lit(0))
    rows = items.select("id", F.col(ord).alias("ord"), near_tokens(F.coalesce("title", F.lit(""))).alias("tokens"), time.alias("time"), score.alias("score"))
    rows = rows.where(F.size("tokens") >= LEAST_TOKENS).withColumn("set", F.md5(F.concat_ws(" ", "tokens")))
    links = like_sets(rows.select("set", "tokens").dropDuplicates(["set"]))
    named = rows.join(components(links).withColumnRenamed("id", "set"), "set", "left").withColumn("story", F.coalesce("story", "set")).drop("set")
    several = named.groupBy("story").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("story")
    # items farther apart than the window are never alike: a component is gone through in stretches of time, if all of its times are known
    several = named.join(several, "story", "left_semi")
    own = Window.partitionBy("story")
    apart = F.coalesce(F.col("time") - F.lag("time").over(own.orderBy("time")) > NEAR_HOURS * 3_600_000, F.lit(False))
    several = several.withColumn("known", F.min(F.col("time") != 0).over(own)).withColumn("apart", apart.cast("int"))
    several = several.withColumn("stretch", F.when(F.col("known"), F.sum("apart").over(own.orderBy("time"))).otherwise(0)).drop("known", "apart")
    gone = several.groupBy("story", "stretch").applyInArrow(_collapsed, f"id {items.schema['id'].dataType.simpleString()}")
    return items.join(gone, "id", "left_anti")
