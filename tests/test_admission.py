import random

from tidewire.operators import admission as A


def brute(rows, limit, window, allowed=None):
    out, state = {}, {}
    for key, origin, ts in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        if allowed is not None and origin not in allowed:
            out[key] = False
            continue
        count, last = state.get(origin, (0, None))
        if last is not None and ts - last >= window:
            count = 0
        out[key] = count < limit
        if out[key]:
            state[origin] = (count + 1, ts)
    return out | {r[0]: False for r in rows if r[0] not in out}


def frame(spark, rows, parts):
    from pyspark.sql import functions as F

    made = spark.createDataFrame([(*r, "x") for r in rows], "id long, origin string, s double, run string")
    return made.select("id", "origin", F.timestamp_seconds("s").alias("ts"), "run").repartition(parts)


def run(spark, rows, parts=5, **more):
    got = A.admitted(frame(spark, rows, parts).drop("run"), **more).collect()
    assert len(got) == len(rows)
    return {r.id: r.admitted for r in got}


def test_against_a_loop(spark):
    rng = random.Random(2)
    rows, at = [], {o: 0.0 for o in "abcdef"}
    for k in range(4000):
        o = rng.choice("aaaaaabcdef")
        at[o] += rng.choice([0, 0, 1, 5, 40, 99.5, 100, 100.5, 300]) * rng.random() ** (3 if o == "a" else 0)
        rows.append((k, o, at[o]))
    rows += [(10_000, None, 5.0), (10_001, "a", None), (10_002, "a/", 4.0)]
    for limit, window in ((3, 100), (1, 100), (20, 50)):
        assert run(spark, rows, limit=limit, window=window) == brute(rows, limit, window)
    assert run(spark, rows, limit=3, window=100, allowed=["a/", " b "]) == brute(rows, 3, 100, {"a", "b"})


def test_one_busy_origin_over_many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(k, "hot", k * 7.0 + (5000 if k > 2500 else 0)) for k in range(5000)] + [(9000 + k, "hot", 35.0) for k in range(40)] + [(9900, "cold", 1.0)]
        assert A.runs(frame(spark, rows, 4).drop("run"), 3600).where("origin = 'hot'").select("run").distinct().count() == 2
        assert run(spark, rows, limit=20, window=3600) == brute(rows, 20, 3600)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    assert run(spark, [], 1) == {}
