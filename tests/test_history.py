"""The stream's state against batch by batch history, through a restart."""

from datetime import timedelta

from tidewire.operators.state import with_history
from tidewire.streaming import history as H

SCHEMA = "id string, title string, fetched_at string, ai_note string"
BATCHES = [
    [("a", "1", "t1", None), ("b", "1", "t1", "note b"), ("c", "1", "t1", None), (None, "no id", "t1", None)],
    [("a", "2", "t2", "note a"), ("b", "2", "t2", None), ("d", "1", "t2", None), ("d", "1 again", "t3", "note d")],
    [("a", "3", "t4", None), ("c", "late", "t0", None), ("b", "3", "t4", "new b"), ("e", "1", "t4", None)],
    [("b", "4", "t5", None), ("d", "2", "t5", None), ("old", "1", "t5", None)],
]


def drained(spark, tmp_path, name, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, ck = str(tmp_path / name), str(tmp_path / f"{name}-ck")
    H.with_history(stream, **more).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(180)
    return sorted((tuple(r) for r in spark.read.parquet(out).select("id", "title", "first_seen", "ai_note").collect()), key=str)


def add(spark, tmp_path, k):
    spark.createDataFrame(BATCHES[k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def batches(spark, known):
    """What batch history gives, one batch after another; rows of an id within a batch are batches of their own."""
    out, now = [], {k: v for k, v in known.items()}
    for batch in BATCHES:
        for row in sorted((r for r in batch if r[0]), key=lambda r: r[2]):
            items = spark.createDataFrame([row], SCHEMA)
            old = spark.createDataFrame([(i, *v) for i, v in now.items()] or [("", None, None)], "id string, first_seen string, ai_note string")
            got = with_history(items, old, row[2]).select("id", "title", "first_seen", "ai_note").first()
            now[row[0]] = (got.first_seen, got.ai_note)
            out.append(tuple(got))
    return sorted(out, key=str)


def test_state_outlives_a_restart(spark, tmp_path):
    known = {"old": ("t-1", "old note"), "a": (None, "first note")}
    previous = spark.createDataFrame([(i, *v) for i, v in known.items()], "id string, first_seen string, ai_note string")
    for k in (0, 1):
        add(spark, tmp_path, k)
        drained(spark, tmp_path, "out", previous=previous)
    add(spark, tmp_path, 2)
    add(spark, tmp_path, 3)
    got = drained(spark, tmp_path, "out", previous=previous)
    assert got == batches(spark, known)


def test_ids_are_forgotten_after_their_time(spark, tmp_path):
    import time

    def ran(k, rows):
        add(spark, tmp_path, k)
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        out = H.with_history(stream, ttl=timedelta(seconds=1)).writeStream.format("parquet").option("path", str(tmp_path / "ttl")).option("checkpointLocation", str(tmp_path / "ck"))
        running = out.trigger(processingTime="1 second").start()
        got, end = [], time.time() + 40
        while len(got) < rows and time.time() < end:
            time.sleep(0.5)
            if list(tmp_path.glob("ttl/_spark_metadata/[0-9]*")):
                got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "ttl")).select("id", "title", "first_seen", "ai_note").collect()]
        running.stop()
        return got

    assert len(ran(0, 3)) == 3
    time.sleep(2)
    got = ran(1, 7)
    assert ("a", "2", "t2", "note a") in got and ("b", "2", "t2", None) in got
