import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewire.llm import sharding as S

SCHEMA = "doc_id long, text string"


def held(got, rows, shards, tolerance):
    """The law, held against every row: the same rows, gapless slots, near equal bytes."""
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total, largest = sum(r["size"] for r in got), max((r["size"] for r in got), default=0)
    for k in range(shards):
        assert sorted(r.slot for r in by[k]) == list(range(len(by[k])))
        assert abs(sum(r["size"] for r in by[k]) - total / shards) <= max(2 * tolerance * total / shards, largest) + 1
    assert set(by) <= set(range(shards))


def test_near_equal_bytes_with_a_hot_text(spark):
    rng = random.Random(3)
    hot = "the same text " * 3
    rows = [(k, hot if rng.random() < 0.4 else rng.choice("abcdé") * rng.randrange(0, 400)) for k in range(6000)]
    rows += [(7, "one row, many times")] * 500 + [(None, None)] * 30 + [(5, "")] * 9 + [(6, "x" * 9000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = S.digests(docs).collect()
    held(got, rows, 24, S.TOLERANCE)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_equal_texts_stay_together_where_they_can(spark):
    rows = [(k, f"text {k // 3} " * 5) for k in range(3000)]
    got = S.digests(spark.createDataFrame(rows, SCHEMA), 4, 0.02).collect()
    held(got, rows, 4, 0.02)
    where = defaultdict(set)
    for r in got:
        where[rows[r.doc_id][1]].add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_pieces_of_shards(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        rows = [(k, "é" * (k % 90)) for k in range(2500)]
        got = S.sharded(spark.createDataFrame([(i, t, "mine", k) for k, (i, t) in enumerate(rows)], SCHEMA + ", shard string, `a.b` int"), 3).withColumn("text_crc32", S.text_crc32(F.col("text"))).collect()
        held(got, rows, 3, S.TOLERANCE)
        assert all(rows[r["a.b"]] == (r.doc_id, r.text) for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_histogram_counts_exactly(spark):
    docs = spark.createDataFrame([(k, f"text {k % 50}") for k in range(400)], SCHEMA)
    rows = S.keyed(docs).select("size", "key").persist()
    keys = [(int.from_bytes(r.key, "big"), r["size"]) for r in rows.collect()]
    probes = sorted({0, 1, S.END - 1, *(k for k, _ in keys[::7]), *(k + 1 for k, _ in keys[::9]), *((k >> 64) << 64 for k, _ in keys[::11])})
    every = sorted(k for k, _ in keys)
    bins = S.histogram(rows, probes)
    for a, b in bins:
        for m in (a, b):
            assert (m.size, m.rows) == (sum(s for k, s in keys if k < m.key), sum(k < m.key for k in every))
        assert a.key in every and b.key - 1 in every and not any(a.key < p < b.key for p in probes)
    assert sum(b.rows - a.rows for a, b in bins) == len(every)


def test_few_rounds_are_enough(spark, monkeypatch):
    """Brackets shrink to rows, so that a splitter inside many equal texts needs few rounds."""
    rounds = []
    real = S.histogram
    monkeypatch.setattr(S, "histogram", lambda rows, probes: rounds.append(len(probes)) or real(rows, probes))
    rows = [(k, "hot " * 9 if k % 2 else f"text {k} " * (k % 40)) for k in range(5000)] + [(9000, "x" * 200_000)]
    held(S.digests(spark.createDataFrame(rows, SCHEMA)).collect(), rows, 24, S.TOLERANCE)
    assert len(rounds) <= 8


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (2, "x" * 300_000), (None, None)]])
def test_few_rows(spark, rows):
    got = S.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    held(got, rows, 24, S.TOLERANCE)
    assert S.digests(spark.createDataFrame(rows, SCHEMA), 1).select("shard").distinct().count() == min(1, len(rows))
