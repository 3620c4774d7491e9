"""Links of stories against all pairs, and what the joins of items carry."""

import random
from collections import Counter

import duckdb

from tidewire.operators import stories
from tidewire.plans import registry, site  # noqa: F401
from tidewire.sources import tables


def test_alike_as_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(stories, "COMMON", 8)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    rows = [(k, rng.randrange(200) * 3600, rng.sample(words[: rng.choice([8, 30])], rng.randrange(8))) for k in range(60)]
    df = Counter(w for *_, tokens in rows for w in tokens)
    want = {}
    for a, s, x in rows:
        for b, t, y in rows:
            both = set(x) & set(y)
            if a < b and abs(s - t) <= 72 * 3600 and len(both) >= 2 and len(both) / len({*x, *y}) >= 0.3 and any(2 <= df[w] <= 8 for w in both):
                want[a, b] = len(both)
    got = stories.alike(spark.createDataFrame(rows, "id long, at long, tokens array<string>").repartition(3))
    assert {(r.a, r.b): r.shared for r in got.collect()} == want and len(want) > 3


def test_titles_are_taken_below_the_joins(spark):
    plan = tables.items(spark, "/root/testdata/sf0.001").select("id", "title", "lines")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Relation")]
    assert "Join" in joined and "split(" not in joined.split("Join")[0]


def test_every_pair_however_common_its_tokens(spark, monkeypatch):
    rng = random.Random(7)
    for name, value in (("BLOCK", 9), ("CELLS", 40), ("HITS", 30)):  # many blocks, and tables of few rows
        monkeypatch.setattr(stories, name, value)
    words = [f"w{k}" for k in range(40)]
    names = ["openai", "rag", "nvidia"]
    rows = [(k, rng.randrange(15 * 24) * 3600, rng.sample(words[:25], rng.randrange(9)), rng.choice([[], [], *([n] for n in names), names[:2]])) for k in range(150)]
    rows += [(200 + k, rng.randrange(15 * 24) * 3600, ["copied", "title"], names[k % 3 : k % 3 + 1]) for k in range(60)]  # copies of three entities
    rows += [(300, 0, ["far", "off"], []), (301, 72 * 3600, ["off", "far"], []), (302, 144 * 3600 + 1, ["far", "off"], []), (303, 0, ["one"], []), (304, 0, [], [])]
    parent = {k: k for k, *_ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, s, x, p in rows:
        for b, t, y, q in rows:
            both = set(x) & set(y)
            if a < b and abs(s - t) <= 72 * 3600 and len(both) >= 2 and len(both) / len({*x, *y}) >= 0.3 and (not p or not q or set(p) & set(q)):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = Counter(root(k) for k, *_ in rows)
    items = spark.createDataFrame([r[:3] for r in rows], "id long, at long, tokens array<string>").repartition(3)
    got = stories.grouped(items, spark.createDataFrame([(r[0], r[3]) for r in rows], "id long, topics array<string>")).collect()
    classes = {}
    for r in got:
        classes.setdefault(r.story, set()).add(r.id)
    assert sorted(map(sorted, (c for c in classes.values() if len(c) > 1))) == sorted(sorted(k for k, *_ in rows if root(k) == x) for x, n in want.items() if n > 1)
    assert {len(t) >= 2 for _, _, t, _ in rows} == {True, False} and {r.id for r in got} == {k for k, _, t, _ in rows if len(t) >= 2}
    assert stories.grouped(items.where("false"), spark.createDataFrame([], "id long, topics array<string>")).count() == 0


def test_focus_stories_by_common_tokens(spark, tmp_path):
    docs = [(k, f"Common words alone {'' if k < 60 else f'rare{k // 2} thing{k // 2}'}", f"src{k % 7}", "en") for k in range(64)]  # the first 60 share only tokens of more than fifty
    frames = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"),
        "events": spark.createDataFrame([(k, k, "view", 1.0) for k in range(64)], "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp'2024-01-03 20:00:00' + make_interval(0, 0, 0, 0, 0, 0, event_id) AS ts"),
        "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([], "page_id long, url string, html string"),
    }
    for name, frame in frames.items():
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = [tuple(r) for r in registry.QUERIES["story_focus"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    for name in frames:
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["story_focus"]).fetchall()
    assert got == want and got[0][:2] == (0, 7)
