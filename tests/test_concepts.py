"""Many queries at once against one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import concepts as C
from tidewire.operators import search

FIELDS = {"name": 5, "topics": 3, "text": 1}
QUERIES = ["", None, "the of 的", "designer agents", "设计 ai 智能体框架", "写代码工具", "完全未知词语 rag", "multi agent swarm", "c++ node.js", "优化 memory", "优化", "missing-word agent", "未知", "UI ux", "gpu 多智能体编程未知", "fine-tune lora", "red-team", "ui"]
ROWS = [
    (1, "Multi-Agent swarm", "rag", "为大家设计 a designed thing"),
    (2, "multiagent", None, "agentic 完全未知 design"),
    (3, "设计 tool", "ui", "gui node.js and c++ 优化"),
    (4, "Agent memory", "memory", "multi agent, better memory, finetuning"),
    (5, None, None, None),
    (6, "fluid quid", "red team", "写代码 多智能体 gpu redteam build"),
    (7, "未知 词语", "lora", "fine tuning of 编程 agents"),
    (8, "rag rag", "c++x", "optimize 改善 design"),
]


@pytest.mark.parametrize("words", [C.DICTIONARY, search.Dictionary([["agent", "智能体"], ["multi-agent", "swarm"], ["写代码", "code"]], [["优化", "better"]], frozenset({"the"}))])
def test_all_queries_as_each_alone(spark, words):
    asked = [(k, q) for k, q in enumerate(QUERIES)]
    groups = C.segmented(spark.createDataFrame(asked, "qid long, query string").repartition(3), words)
    got = {k: [] for k, _ in asked}
    for r in groups.collect():
        got[r.qid].append((r.k, search.Group(tuple(r.terms), r.soft, r.phrase)))
    alone = {k: search.concepts_of(q or "", words) for k, q in asked}
    assert {k: [g for _, g in sorted(v, key=lambda x: x[0])] for k, v in got.items()} == alone
    rows = spark.createDataFrame(ROWS, "id long, name string, topics string, text string").repartition(2)
    at_once = C.TERMS_AT_ONCE
    C.TERMS_AT_ONCE = 17  # several scans
    try:
        ranked = C.ranked(rows, groups, FIELDS).collect()
    finally:
        C.TERMS_AT_ONCE = at_once
    weights = rows.select("id", *(search.group_weight(g.terms, FIELDS).alias(f"w{k}_{n}") for k, own in alone.items() for n, g in enumerate(own))).collect()
    met = {r["id"]: r.asDict() for r in weights}
    for k, own in alone.items():
        want = brute(own, {i: [m[f"w{k}_{n}"] for n in range(len(own))] for i, m in met.items()})
        assert {r.id: r.score for r in ranked if r.qid == k} == pytest.approx(want, abs=2e-6), QUERIES[k]


def brute(groups, weights):
    import math

    n, hard = len(weights), any(not g.soft for g in groups)
    df = [sum(w[k] > 0 for w in weights.values()) for k in range(len(groups))]
    if not groups or any(not g.soft and not g.phrase and not df[k] for k, g in enumerate(groups)):
        return {}
    out = {}
    for i, w in weights.items():
        if any(w[k] > 0 and not (hard and g.soft) for k, g in enumerate(groups)):
            out[i] = round(sum(math.log(1 + n / (1 + df[k])) * (0.4 if g.soft else 1) * w[k] for k, g in enumerate(groups)), 6)
    out = {i: s for i, s in out.items() if s > 0}
    return {i: s for i, s in out.items() if s >= 0.5 * max(out.values())}


def test_segmenter_on_random_stretches():
    rng = random.Random(6)
    segmenter = C.Segmenter(C.DICTIONARY)
    pieces = [t for g in C.CONCEPTS for t in g] + ["的", "在", "天", "地", "x", "of", " ", "-", "zz9"]
    for _ in range(1500):
        query = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        assert segmenter.segmented(query) == search.concepts_of(query, C.DICTIONARY), query
    assert len(C.CONCEPTS) == 93


def test_empty_tables(spark):
    none = C.segmented(spark.createDataFrame([], "qid long, query string"))
    rows = spark.createDataFrame(ROWS, "id long, name string, topics string, text string")
    assert none.count() == 0 and C.ranked(rows, none, FIELDS).count() == 0
    some = C.segmented(spark.createDataFrame([(1, "agent")], "qid long, query string"))
    assert C.ranked(rows.where(F.lit(False)), some, FIELDS).count() == 0


def test_a_common_concept_is_many_tasks(spark):
    rows = spark.range(4000).selectExpr("id", "'agent memory' AS name")
    queries = spark.createDataFrame([(1, "agent memory"), (2, "agent")], "qid long, query string")
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(before, ("-1", "false")):
            spark.conf.set(c, v)
        got = C.ranked(rows, C.segmented(queries), {"name": 5}).select("qid", F.spark_partition_id().alias("p")).groupBy("qid", "p").count().collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sum(r["count"] for r in got) == 8000 and len(got) == 8 and max(r["count"] for r in got) < 2000


def test_few_rows_are_objects_at_once():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"qid": list(range(1000))})
    parts = list(C._few(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= 256 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(1000))
