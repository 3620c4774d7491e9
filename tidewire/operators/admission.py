"""Admission of requests: an allowlist of origins, and a limit on each one's requests that refused ones don't count against.

An origin's count ends a window after its last admitted request; at the limit, requests are refused until then.  What is
decided depends on all earlier decisions, but not on those before an idle window: requests are put in order by ranges over all origins, each run without such
a gap is one key, and runs are folded in time order, batch by batch, with a count and a time as the only state.  An origin with many requests
is as many keys as it has idle windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidewire.lineage import shared_folder

LIMIT, WINDOW_SECONDS = 20, 3600


def runs(requests: DataFrame, window: float = WINDOW_SECONDS, origin: str = "origin", time: str = "ts", key: str = "id") -> DataFrame:
    """requests with run, the time in microseconds at which the run of each one began; a run ends where the origin is idle for a window.

    Rows without an origin or a time are left out.  The order is by ranges, so that a busy origin is many tasks; of each range only its ends meet those of others.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = requests.where(F.col(origin).isNotNull() & F.col(time).isNotNull()).withColumn("_at", at)
    order = [origin, "_at", key]
    path = shared_folder(requests.sparkSession, "requests")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = requests.sparkSession.read.parquet(path)
    inside = Window.partitionBy("_part", origin).orderBy("_at", key)
    # the last time of the same origin in the ranges before; only ranges' ends are looked at
    ends = rows.groupBy("_part", origin).agg(F.min("_at").alias("first"), F.max("_at").alias("last"))
    across = Window.partitionBy(origin).orderBy("_part")
    ends = ends.withColumn("before", F.lag("last").over(across))
    gap = int(window * 1e6)
    marked = rows.join(ends.select("_part", origin, "before"), ["_part", origin])
    prior = F.coalesce(F.lag("_at").over(inside), "before")
    marked = marked.withColumn("_start", F.when(prior.isNull() | (F.col("_at") - prior >= gap), F.col("_at")))
    held = F.last("_start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_held", held)
    # a range that begins inside a run has its start from the last range that has one
    starts = marked.groupBy("_part", origin).agg(F.max("_start").alias("latest"))
    carried = F.last("latest", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("_part", origin, carried.alias("carried"))
    return marked.join(starts, ["_part", origin]).withColumn("run", F.coalesce("_held", "carried")).drop("_part", "before", "_start", "_held", "carried")


def _folded(limit: int, gap: int, origin: str):
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by origin, run and time; the state goes on from batch to batch."""
        owner, count, last = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at, run = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_at", "run"))
            names = batch.column(origin)
            new = np.ones(batch.num_rows, bool)
            new[1:] = (run[1:] != run[:-1]) | pa.compute.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
            ok = np.zeros(batch.num_rows, bool)
            edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if owner != (names[a].as_py(), int(run[a])):
                    owner, count, last = (names[a].as_py(), int(run[a])), 0, int(at[a])
                while a < b:
                    if count >= limit:  # the next that comes a window after the last admitted one
                        a += int(np.searchsorted(at[a:b], last + gap))
                        if a == b:
                            break
                        count = 0
                    n = min(limit - count, b - a)
                    ok[a : a + n] = True
                    count, last, a = count + n, int(at[a + n - 1]), a + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok)], [*batch.schema.names, "admitted"])

    return folded


def admitted(requests: DataFrame, limit: int = LIMIT, window: float = WINDOW_SECONDS, allowed: list[str] | None = None, origin: str = "origin", time: str = "ts", key: str = "id") -> DataFrame:
    """requests (origin, ts, id, ...) with admitted: whether each passes the allowlist (all do without one) and the limit.

    Requests of one time are taken by id.  Those without an origin or a time are refused and don't count, nor do those of origins that
    aren't allowed.  Origins of the list match exactly, but for a / at their end.
    """
    own = requests.columns
    known = F.col(origin).isNotNull() & F.col(time).isNotNull()
    if allowed is not None:
        known = known & F.col(origin).isin([o.strip().rstrip("/") for o in allowed])
    known = F.coalesce(known, F.lit(False))
    dealt = runs(requests.where(known), window, origin, time, key)
    dealt = dealt.repartition(F.col(origin), F.col("run")).sortWithinPartitions(origin, "run", "_at", key)
    schema = StructType([*dealt.schema.fields, StructField("admitted", BooleanType())])
    out = dealt.mapInArrow(_folded(limit, int(window * 1e6), origin), schema).select(*own, "admitted")
    return out.unionByName(requests.where(~known).withColumn("admitted", F.lit(False)))
