"""Packing of names into bounded requests, one after another in order, and the requests' second round.

A request takes names until the next one would make it too long.  Where a name falls depends on all before it, but
only through the letters that the open request has: each range of names is a table from these to those after it, which
the driver chains (a table for each range), so that ranges are packed at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewire.lineage import shared_folder

LONGEST, PREFIX = 250, "repo:"


def _tables(longest: int):
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each length that the open request can have: that after the partition, and the requests begun in it."""
        from pyspark import TaskContext

        after, begun, seen = np.arange(longest + 2), np.zeros(longest + 2, np.int64), False
        for batch in batches:
            for w in batch.column("_w").to_pylist():
                fresh = (after == 0) | (after + w > longest)
                begun += fresh
                after = np.where(fresh, min(w, longest + 1), after + w)  # one that is too long by itself takes no more
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([after.tolist()]), pa.array([begun.tolist()])], ["part", "after", "begun"])

    return tables


def _numbered(entries, longest: int):
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used, number = None, 0, 0
        for batch in batches:
            out = []
            for p, w in zip(batch.column("_part").to_pylist(), batch.column("_w").to_pylist()):
                if p != part:
                    part, (used, number) = p, entries.value[p]
                if used == 0 or used + w > longest:
                    used, number = 0, number + 1
                used = min(used + w, longest + 1)
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "request"])

    return numbered


def packed(names: DataFrame, order: str = "ord", name: str = "name", longest: int = LONGEST, prefix: str = PREFIX) -> DataFrame:
    """names with request, from 1 on: in order, a request ends before the name that would make it longer than `longest` letters, a space after each name included.

    A name that is too long by itself is a request of its own.  Names of equal order are taken by name; null names are left out.
    """
    spark, own = names.sparkSession, names.columns
    path = shared_folder(spark, "names")
    rows = names.where(F.col(name).isNotNull()).withColumn("_w", (F.char_length(name) + len(prefix) + 1).cast("int"))
    rows.repartitionByRange(order, name).sortWithinPartitions(order, name).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path).repartitionById(max(1, spark.read.parquet(path).agg(F.max("_part")).first()[0] or 0) + 1, F.col("_part")).sortWithinPartitions(order, name)
    found = rows.select("_w").mapInArrow(_tables(longest), "part int, after array<long>, begun array<long>").collect()
    entries, used, number = {}, 0, 0
    for r in sorted(found, key=lambda r: r.part):
        entries[r.part] = (used, number)
        used, number = r.after[used], number + r.begun[used]
    schema = StructType([*rows.schema.fields, StructField("request", LongType())])
    return rows.mapInArrow(_numbered(spark.sparkContext.broadcast(entries), longest), schema).select(*own, "request")


def requests(rows: DataFrame, order: str = "ord", name: str = "name", prefix: str = PREFIX) -> DataFrame:
    """(request, query, n) of packed names: what is asked, and for how many names."""
    each = rows.groupBy("request").agg(F.sort_array(F.collect_list(F.struct(order, name))).alias("names"))
    return each.select("request", F.array_join(F.transform("names", lambda x: F.concat(F.lit(prefix), x[name])), " ").alias("query"), F.size("names").cast("long").alias("n"))


def asked(rows: DataFrame, search: Callable[[str], list[tuple]], schema: str, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(answers, failed) of requests (request, query): the rows of search(query), which executors call; requests that raise are asked once more in the next round.

    answers has request and the columns of schema; failed has (request, query, error) of those that failed in the last round, 200 characters of the error.
    """
    spark = rows.sparkSession
    names = [f.split()[0] for f in schema.split(", ")]

    def called(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for request, query in zip(frame["request"], frame["query"]):
                try:
                    out.append((request, query, [dict(zip(names, row)) for row in search(query)], None))
                except Exception as e:  # noqa: BLE001  whatever a client raises is this request's failure
                    out.append((request, query, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["request", "query", "found", "error"])

    fields = f"request long, query string, found array<struct<{schema}>>, error string"
    answers, left = None, rows.select("request", "query")
    for _ in range(rounds):
        path = shared_folder(spark, "answers")
        left.mapInPandas(called, fields).write.parquet(path)
        got = spark.read.schema(fields).parquet(path)
        good = got.select("request", F.inline("found"))
        answers = good if answers is None else answers.unionByName(good)
        failed = got.where(F.col("error").isNotNull()).select("request", "query", "error")
        left = failed.select("request", "query")
    return answers, failed
