"""What is known of items, carried through a stream: when each was first seen, and the note it was given.

State is a value for each id that expires after a while without the item.  It lives in the checkpoint, so that a query that
is started again goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StringType, StructType

STATE = "first_seen string, ai_note string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _set(value) -> bool:
    return value is not None and not pd.isna(value)


class History(StatefulProcessor):
    """Stamps each row with the first time and the note of its id: its own, else those of the state, else its order and no note.

    Rows of an id in one batch are taken by order, then as they come.  What a row has itself goes into the state, so that a note that was written later stays.
    """

    def __init__(self, columns: list[str], order: str, ttl: timedelta | None) -> None:
        self.columns, self.order, self.ttl = columns, order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", STATE, int(self.ttl.total_seconds() * 1000) if self.ttl else None)

    def handleInitialState(self, key, initial: pd.DataFrame, timers: TimerValues) -> None:  # noqa: N802
        for first, note in zip(initial["first_seen"], initial["ai_note"]):
            self.known.update((first if _set(first) else None, note if _set(note) else None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        first, note = self.known.get() if self.known.exists() else (None, None)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        firsts, notes = [], []
        for at, own_first, own_note in zip(batch[self.order], batch["first_seen"], batch["ai_note"]):
            first = own_first if _set(own_first) else first if _set(first) else at
            note = own_note if _set(own_note) else note
            firsts.append(first)
            notes.append(note if _set(note) else None)
        self.known.update((first if _set(first) else None, note if _set(note) else None))
        yield batch.assign(first_seen=firsts, ai_note=notes)[self.columns]

    def close(self) -> None:
        pass


def with_history(items: DataFrame, order: str = "fetched_at", ttl: timedelta | None = None, previous: DataFrame | None = None) -> DataFrame:
    """A stream of items (id, ..., order: a time as text) with first_seen and ai_note, as if each batch met all earlier ones.

    previous, a table (id, first_seen, ai_note), is what is known when the stream is first started.  ttl: how long an id is known after its last row, in processing
    time; without it, for ever.  With it the query goes on looking for what has expired, so that it needs a trigger by time: "available now" would
    not end.  Rows without an id are left out.  The state is kept in RocksDB.
    """
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    for c in ("first_seen", "ai_note"):
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast("string"))
    out = StructType([f for f in items.schema.fields])
    for c in ("first_seen", "ai_note"):
        out[c].dataType, out[c].nullable = StringType(), True
    known = previous.select("id", "first_seen", "ai_note").where("id is not null").groupBy("id") if previous is not None else None
    return items.where("id is not null").groupBy("id").transformWithStateInPandas(History(items.columns, order, ttl), out, "Append", "ProcessingTime" if ttl else "None", known)
