"""Snapshots and the monthly archive."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.lineage import cut
from tidewire.sources import versions


def upserted(old: DataFrame, new: DataFrame, key: str = "id", order: str = "published_at") -> DataFrame:
    """old and new by key; where both have it the new row stands, all columns of it.  Of several new rows of a key the last in order stands."""
    if order in new.columns:
        latest = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*new.columns))
        new = new.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    else:
        new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def totals(items: DataFrame) -> DataFrame:
    """(month, n) of the archive's months, and their sum in the row whose month is null."""
    return items.rollup("month").agg(F.count(F.lit(1)).alias("n"))


def with_month(items: DataFrame) -> DataFrame:
    """Items with the month of the first time that isn't empty; those without a month are left out."""
    when = F.coalesce(F.nullif("first_seen", F.lit("")), F.nullif("published_at", F.lit("")))
    return items.withColumn("month", F.substring(when, 1, 7)).where(F.col("month").rlike("^\\d{4}-\\d{2}$"))


def write_archive(spark: SparkSession, items: DataFrame, path: str) -> None:
    """Upserts items into the months that they touch; other months' files stay."""
    new = with_month(items)
    if months_of(spark, path):
        old = spark.read.parquet(path).join(new.select("month").distinct(), "month", "left_semi")
        new = cut(upserted(old, new))  # read before it is overwritten
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def months_of(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """The months of an archive with the number and bytes of their files, from the names of its folders; no file is opened."""
    fs, root = versions.file_system(spark, path)
    found = {}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        if status.isDirectory() and re.fullmatch(r"month=\d{4}-\d{2}", name):
            files = [f for f in fs.listStatus(status.getPath()) if f.isFile() and f.getPath().getName()[0] not in "._"]
            if files:
                found[name[6:]] = (len(files), sum(f.getLen() for f in files))
    return found


def expire(spark: SparkSession, path: str, now: str, months: int = 3) -> list[tuple[str, int, int]]:
    """Removes the folders of all months but the last `months` calendar months up to now, a date, and of none after it: (month, files, bytes) of those that went.

    Other months aren't read, and a second run removes nothing.
    """
    year, month = int(now[:4]), int(now[5:7]) - months
    least = f"{year + month // 12:04}-{month % 12 + 1:02}"
    gone = [(m, *held) for m, held in sorted(months_of(spark, path).items()) if m < least]
    fs, _ = versions.file_system(spark, path)
    for m, *_ in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/month={m}"), True)
    return gone


def rewritten(spark: SparkSession, path: str, changes: dict[str, Column]) -> list[str]:
    """Puts new values into columns of an archive where they differ from the old; only months with such rows are written.  Returns these, in order.

    A second run with rules that leave their own results alone finds none and writes nothing.
    """
    rows = spark.read.parquet(path)
    differs = ~reduce(Column.__and__, [F.col(c).eqNullSafe(v) for c, v in changes.items()])
    touched = sorted(r.month for r in rows.where(differs).select("month").distinct().collect())  # a row for each month
    if touched:
        new = cut(rows.where(F.col("month").isin(touched)).withColumns(changes))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return touched


def kept_months(items: DataFrame, now: str, months: int = 3) -> DataFrame:
    """Rows of the last `months` calendar months up to now, a date."""
    least = F.date_format(F.add_months(F.to_date(F.lit(now)), -(months - 1)), "yyyy-MM")
    return items.where(F.col("month") >= least)


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
