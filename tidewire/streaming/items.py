"""Streams of items: windowed counts with late data, first-seen state, and upserts into the archive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.sources.archive import write_archive


def windowed_counts(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(day, category, n) over tumbling windows; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "category").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "category", "n")


def sessions(events: DataFrame, gap: str = "72 hours", late: str = "1 day") -> DataFrame:
    """(source, start, end, n) of runs of events that are at most the gap apart."""
    out = events.withWatermark("ts", late).groupBy("source", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("source", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, late: str = "7 days") -> DataFrame:
    """The first row of each id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def sliding_gains(stars: DataFrame, window: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """(repo, start, end, gained) of star events (repo, ts) over windows of a length that begin a step apart."""
    out = stars.withWatermark("ts", late).groupBy("repo", F.window("ts", window, step).alias("w")).agg(F.count(F.lit(1)).alias("gained"))
    return out.select("repo", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "gained")


def star_history(samples: DataFrame, most: int = 60) -> DataFrame:
    """(repo, history) of a stream of samples (repo string, date string, stars long): after each batch the last samples of every repository in it.

    A sample of a date that is there already takes its place.  The state of a repository is bounded by the number of samples.
    """

    def extended(key, batches, state: GroupState):
        kept = dict(zip(*state.get)) if state.exists else {}
        for rows in batches:
            kept.update(zip(rows["date"], rows["stars"].astype(int)))
        kept = dict(sorted(kept.items())[-most:])
        state.update((list(kept), list(kept.values())))
        yield pd.DataFrame({"repo": [key[0]], "history": [[{"date": d, "stars": n} for d, n in kept.items()]]})

    return samples.groupBy("repo").applyInPandasWithState(extended, "repo string, history array<struct<date: string, stars: long>>", "dates array<string>, stars array<long>", "update", GroupStateTimeout.NoTimeout)


def archive_stream(items: DataFrame, path: str, checkpoint: str):
    """Upserts each batch into the monthly archive; a batch that is run again gives the same archive."""

    def merge(batch: DataFrame, _: int) -> None:
        write_archive(batch.sparkSession, batch, path)

    return items.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
