"""Snapshots, retention, backfill, counts of what is dropped, and packing of requests."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import notes
from tidewire.operators import classify, packing
from tidewire.sources import archive, snapshots, versions


def test_a_failed_write_leaves_the_snapshot(spark, tmp_path):
    path = str(tmp_path / "s")
    assert snapshots.read_snapshot(spark, path) is None
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, source string")
    snapshots.write_snapshot(rows, path, "one")
    bad = rows.withColumn("id", F.when(F.col("id") == "2", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        snapshots.write_snapshot(bad, path, "two")
    items, meta = snapshots.read_snapshot(spark, path)
    assert items.count() == 2 and (meta.first().fetched_at, meta.first()["count"]) == ("one", 2)
    snapshots.write_snapshot(rows.where("false"), path, "three")
    items, meta = snapshots.read_snapshot(spark, path)
    assert items.count() == 0 and meta.first().fetched_at == "three"
    assert len(versions.vacuum(spark, path)) == 2 and snapshots.read_snapshot(spark, path)[0].count() == 0


def test_repositories_and_their_file(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("a/b", ["x", "y"]), ("c/d", ["x"])], "full_name string, sources array<string>")
    assert snapshots.read_repos(spark, path) is None
    snapshots.write_repos(rows, path, "t1")
    snapshots.write_repos(rows.where("full_name = 'a/b'"), path, "t2")
    found, at = snapshots.read_repos(spark, path)
    assert [r.full_name for r in found.collect()] == ["a/b"] and at.values == {"fetched_at": "t2", "started_at": "t1"}
    about = spark.read.json(versions.paths(path, at, "about")[0]).first()
    assert (about.started_at, about.fetched_at, about["count"]) == ("t1", "t2", 1)
    for name, body, want in (("good", '{"fetchedAt": "n", "repos": [{"full_name": "a/b", "stars": 3}, {}]}', 2), ("empty", '{"repos": []}', 0), ("none", '{"other": 1}', None), ("text", '{"repos": "x"}', None), ("object", '{"repos": {"a": [1]}}', None), ("bad", "oops", None)):
        (tmp_path / f"{name}.json").write_text(body)
        got = snapshots.read_repo_file(spark, str(tmp_path / f"{name}.json"), "full_name string, stars long").collect()
        assert [len(r.repos) for r in got] == ([] if want is None else [want])
    assert snapshots.read_repo_file(spark, str(tmp_path / "missing.json"), "full_name string").count() == 0


def test_retention_and_backfill(spark, tmp_path):
    path = str(tmp_path / "a")
    assert archive.expire(spark, path, "2026-03-09") == [] and archive.months_of(spark, path) == {}
    rows = [(k, f"2026-{k:02}-05" if k < 13 else f"2025-{k - 12:02}-01", "", f"note {k}" + (" (#2)" if k in (2, 14) else "")) for k in range(1, 25)]
    archive.write_archive(spark, spark.createDataFrame(rows, "id long, published_at string, first_seen string, note string"), path)
    files = lambda: {m: sorted(os.listdir(f"{path}/month={m}")) for m in archive.months_of(spark, path)}
    before = files()
    assert archive.rewritten(spark, path, {"note": notes.without_marks(F.col("note"))}) == ["2025-02", "2026-02"]
    after = files()
    assert {m for m in after if after[m] != before[m]} == {"2025-02", "2026-02"}
    assert archive.rewritten(spark, path, {"note": notes.without_marks(F.col("note"))}) == [] and files() == after
    assert sorted((r.id, r.note) for r in spark.read.parquet(path).collect()) == [(k, f"note {k}") for k in range(1, 25)]
    (tmp_path / "a" / "month=2025-03" / "part-bad.parquet").write_bytes(b"can't be read")  # nor is it
    gone = archive.expire(spark, path, "2026-01-15")
    assert [m for m, *_ in gone] == [f"2025-{k:02}" for k in range(1, 11)] and all(n >= 1 and size > 0 for _, n, size in gone)
    assert archive.expire(spark, path, "2026-01-15") == [] and set(archive.months_of(spark, path)) == {"2025-11", "2025-12", *(f"2026-{k:02}" for k in range(1, 13))}
    assert {m: f for m, f in files().items()} == {m: f for m, f in after.items() if m > "2025-10"}


ITEMS = "id string, title string, source string, source_url string, engagement double, heat double"


def test_what_is_dropped_is_counted_in_one_scan(spark, tmp_path):
    rows = [("1", "t", "s", "http://x", None, 1.0), (None, None, "s", "http://x", None, 1.0), ("2", " ", "s", "ftp://x", None, 1.0), ("3", "t", None, "http://x", None, 1.0), ("4", "t", "s", "ftp://x", None, 1.0), ("5", "t", "s", "https://x", None, -1.0)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, ITEMS).coalesce(1).write.parquet(path)
    kept, seen = classify.observed(spark.read.parquet(path))
    assert sorted(r.id for r in kept.collect()) == ["1", "5"]
    assert seen.get == {"n": 6, "kept": 2, "no_id": 1, "no_title": 1, "no_source": 1, "no_source_url": 1}
    assert kept._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    stream = classify.observed_stream(spark.readStream.schema(ITEMS).parquet(path))
    query = stream.writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(60)
    metrics = [p.observedMetrics["sanitiser"] for p in query.recentProgress if p.numInputRows]
    assert [(m.n, m.kept, m.no_source_url) for m in metrics] == [(6, 2, 1)]
    none, seen = classify.observed(spark.createDataFrame([], ITEMS))
    assert none.collect() == [] and seen.get["n"] == 0


def loop(names, longest=250):
    out, cur, used = [], [], 0
    for n in names:
        part = f"repo:{n}"
        if cur and used + len(part) + 1 > longest:
            out.append(" ".join(cur))
            cur, used = [], 0
        cur.append(part)
        used += len(part) + 1
    return [*out, " ".join(cur)] if cur else out


@pytest.mark.parametrize("n,parts", [(0, 1), (1, 1), (3000, 9)])
def test_packing_is_the_loop(spark, n, parts):
    rng = random.Random(n)
    names = ["n" * rng.choice([1, 5, 20, 60, 100, 243, 244, 245, 400]) + str(k) for k in range(n)]
    rows = spark.createDataFrame([(k // 2 * 2, x, "y") for k, x in enumerate(names)] + ([(1, None, "y")] if n else []), "ord long, name string, _part string").drop("_part").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = packing.requests(packing.packed(rows)).orderBy("request").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = [x for _, x in sorted((k // 2 * 2, x) for k, x in enumerate(names))]
    assert [r.query for r in got] == loop(ordered) and [r.request for r in got] == list(range(1, len(got) + 1))
    assert sum(r.n for r in got) == n


def test_failed_requests_are_asked_once_more(spark, tmp_path):
    seen = str(tmp_path)

    def search(query):
        mark = os.path.join(seen, str(len(query)))
        first = not os.path.exists(mark)
        open(mark, "a").write("x")
        if "never" in query or ("twice" in query and first):
            raise OSError(f"no answer to {query} " + "z" * 300)
        return [(q.removeprefix("repo:"), len(q)) for q in query.split(" ") if "unknown" not in q]

    rows = spark.createDataFrame([(1, "repo:a repo:bb"), (2, "repo:twice"), (3, "repo:never-at-all"), (4, "repo:unknown-name-only")], "request long, query string")
    answers, failed = packing.asked(rows, search, "name string, letters long")
    assert sorted(tuple(r) for r in answers.collect()) == [(1, "a", 6), (1, "bb", 7), (2, "twice", 10)]
    assert [(r.request, len(r.error)) for r in failed.collect()] == [(3, 200)]
    assert sorted(len(open(tmp_path / f).read()) for f in os.listdir(tmp_path)) == [1, 1, 2, 2]
