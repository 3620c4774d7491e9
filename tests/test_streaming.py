from pyspark.sql import functions as F

from tidewire.streaming import items as S

SCHEMA = "id long, source string, category string, ts timestamp, published_at string, first_seen string"


def written(spark, path, rows):
    frame = spark.createDataFrame(rows, "id long, source string, category string, t string")
    frame.select("id", "source", "category", F.to_timestamp("t").alias("ts"), F.col("t").alias("published_at"), F.lit("").alias("first_seen")).coalesce(1).write.mode("append").parquet(path)


def drained(stream, name):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


ROWS = [(1, "a", "x", "2026-01-01 10:00:00"), (2, "a", "x", "2026-01-01 11:00:00"), (3, "b", "y", "2026-01-02 10:00:00"), (1, "a", "x", "2026-01-02 12:00:00"), (4, "a", "x", "2026-01-09 10:00:00")]


def test_counts_sessions_and_first_seen(spark, tmp_path):
    path = str(tmp_path / "in")
    written(spark, path, ROWS)
    written(spark, path, [(5, "z", "x", "2026-03-01 00:00:00")])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    drained(S.windowed_counts(stream), "counts")
    assert {(r.day, r.category, r.n) for r in spark.table("counts").collect()} >= {("2026-01-01", "x", 2), ("2026-01-02", "y", 1)}
    drained(S.sessions(stream), "sessions")
    assert sorted(r.n for r in spark.table("sessions").where("source = 'a'").collect()) == [1, 3]
    drained(S.first_seen(stream), "firsts")
    assert spark.table("firsts").where("id = 1").count() == 1


def test_archive_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    written(spark, path, ROWS)
    S.archive_stream(spark.readStream.schema(SCHEMA).parquet(path).dropDuplicates(["id"]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_sliding_gains_and_star_histories(spark, tmp_path):
    schema = "repo string, ts timestamp, date string, stars long"
    day = lambda i: f"2024-01-{i:02d}"
    first = spark.createDataFrame([("a", None, day(i), i) for i in range(1, 9)] + [("b", None, day(1), 5)], schema).withColumn("ts", F.to_timestamp("date"))
    later = spark.createDataFrame([("a", None, day(8), 80), ("a", None, day(9), 90)], schema).withColumn("ts", F.to_timestamp("date"))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    first.coalesce(1).write.mode("append").parquet(path)

    def run(name, build, mode):
        stream = build(spark.readStream.schema(schema).parquet(path))
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{out}-{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    got = {r.repo: [(s.date, s.stars) for s in r.history] for r in run("h1", lambda s: S.star_history(s.select("repo", "date", "stars"), 3), "update")}
    assert got == {"a": [(day(6), 6), (day(7), 7), (day(8), 8)], "b": [(day(1), 5)]}
    wins = {(r.repo, str(r.start)[:10]): r.gained for r in run("g1", lambda s: S.sliding_gains(s), "complete")}
    assert wins[("a", day(1))] == 7 and wins[("a", day(2))] == 7 and wins[("a", day(5))] == 4 and wins[("b", day(1))] == 1
    later.coalesce(1).write.mode("append").parquet(path)
    stream = S.star_history(spark.readStream.schema(schema).parquet(path).select("repo", "date", "stars"), 3)
    stream.writeStream.format("memory").queryName("h2").outputMode("update").option("checkpointLocation", f"{out}-h2").trigger(availableNow=True).start().awaitTermination()
    last = [r for r in spark.table("h2").collect() if r.repo == "a"][-1]
    assert [(s.date, s.stars) for s in last.history] == [(day(7), 7), (day(8), 80), (day(9), 90)]
