import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import language_model as L


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def made():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    rows = []
    for i in range(150):
        w = [rng.choices(vocab, weights)[0]]
        for _ in range(rng.randrange(60)):
            w.append(vocab[(vocab.index(w[-1]) * 7 + rng.randrange(3)) % 200] if rng.random() < 0.7 else rng.choices(vocab, weights)[0])
        rows.append((i, (" ".join(w) + f" rare{i} É").replace("w1 ", "W1\t")))
    return rows + [(7, rows[7][1]), (500, None), (501, ""), (None, "w1 w2 new"), (502, "unseen " * 5), (503, rows[7][1])]


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_against_brute_force(spark, size):
    rows = made()
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    got = L.score_texts(docs, out, size).collect()
    assert len(got) == len(rows)
    c = Counter(t for i, x in rows if not held(i) for t in toks(x))
    N, V = sum(c.values()), len(c)
    by = {}
    for i, x in rows:
        t = toks(x)
        by[i] = (held(i), len(t), sum(c[w] > 0 for w in t), N, sum(math.log10((c[w] + 0.1) / (N + 0.1 * (V + 1))) for w in t))
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == by[r.doc_id][:4]
        assert r.base_score == pytest.approx(by[r.doc_id][4], rel=1e-9)
    seven = {round(r.score, 4) for r in got if r.doc_id in (7, 503)}
    assert len(seven) == 1
    away = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    if size > 1000:  # all words are modelled: contexts help
        assert sum(r.score for r in away) > sum(r.base_score for r in away)


def test_score_is_the_interpolation(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    kept = {}
    real = L.weights
    L.weights = lambda w, cells: kept.setdefault("mix", real(w, cells))
    try:
        got = L.score_texts(docs, out).collect()
    finally:
        L.weights = real
    c, b = Counter(), Counter()
    for i, x in rows:
        if not held(i):
            t = ["</s>", *toks(x)]
            c.update(t[1:])
            b.update(zip(t, t[1:]))
    N, size = sum(c.values()), len(c) + 1
    for r in got:
        text = next(x for i, x in rows if i == r.doc_id)
        t, total = ["</s>", *toks(text)], 0.0
        for h, w in zip(t, t[1:]):
            m = kept["mix"][min(23, int(math.log2(max(1, c[h]))))]
            if c[w] == 0:  # the class of other words, which training has none of
                total += math.log10(m[2] / size) + math.log10(0.1 / 0.1)
            else:
                total += math.log10(m[0] * b[h, w] / max(1, c[h]) + m[1] * c[w] / N + m[2] / size)
        assert r.score == pytest.approx(total, rel=1e-6)


@pytest.mark.parametrize("size", [0, 40])
def test_words_outside_the_head_keep_their_own_counts(spark, size):
    rows = made() + [(600, "rare3 rare4 É"), (601, "rare3 rare4 rare3 rare4 nowhere rare5"), (602, "rare3 rare4 nowhere")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    whole, small = (sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in L.score_texts(docs, out, s).collect()) for s in (1 << 20, size))
    for a, b in zip(whole, small):
        assert a[:3] == b[:3] and b[3:] == pytest.approx(a[3:], rel=1e-4)


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(0)
    f = rng.random((4000, 3))
    truth = np.array([0.6, 0.3, 0.1])
    w = L.expectation_maximisation(f, f @ truth, np.full(3, 1 / 3), 5000)
    near = [truth + d for d in ([0.05, -0.05, 0], [0, 0.05, -0.05], [-0.05, 0, 0.05])]
    value = lambda v: (f @ truth * np.log(f @ v)).sum()
    assert all(value(w) >= value(v) for v in [truth, *near])


def test_packing_and_empty_tables(spark):
    x = np.sort(np.random.default_rng(1).integers(0, 2**62, 1000).astype(np.uint64))
    assert np.array_equal(L._unpack(L._pack(x)), x)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.score_texts(none, F.lit(False)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = L.score_texts(one, F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0) and r.score < 0


def test_a_hot_bigram_and_a_very_long_text(spark):
    rows = [(i, "hot pair " * 50 + f"own{i}") for i in range(40)] + [(100, "hot pair " * 20_000), (101, " ".join(f"only{k}" for k in range(20_000))), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    got = {r.doc_id: r for r in L.score_texts(docs, out).collect()}
    c = Counter(t for i, x in rows if not held(i) for t in toks(x))
    total = sum(c.values())
    for i, x in rows:
        assert (got[i].n_tokens, got[i].train_tokens) == (len(toks(x)), total)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[t] + 0.1) / (total + 0.1 * (len(c) + 1))) for t in toks(x)), rel=1e-9)
        assert math.isfinite(got[i].score)
    assert got[100].score / got[100].n_tokens > got[100].base_score / got[100].n_tokens


def test_repeated_rows_in_another_order(spark, tmp_path):
    """Two files hold the same rows, the second in reverse: every row scores as its text does by the counts of both."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"v{rng.randrange(6000)}" for _ in range(2000 + 400 * i))) for i in range(6)]
    path = str(tmp_path / "docs")
    for part in (rows, rows[::-1]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    docs = spark.read.option("maxPartitionBytes", "1b").parquet(path)
    kept = {}
    real = L.weights
    L.weights = lambda w, cells: kept.setdefault("mix", real(w, cells))
    try:
        got = L.score_texts(docs, F.col("doc_id") == 0).collect()
    finally:
        L.weights = real
    c, b = Counter(), Counter()
    for i, x in rows + rows:
        if i:
            t = ["</s>", *toks(x)]
            c.update(t[1:])
            b.update(zip(t, t[1:]))
    n, size = sum(c.values()), len(c) + 1
    assert len(got) == 12
    for r in got:
        t, total = ["</s>", *toks(rows[r.doc_id][1])], 0.0
        for h, w in zip(t, t[1:]):
            m = kept["mix"][min(23, int(math.log2(max(1, c[h]))))]
            total += math.log10(m[0] * b[h, w] / max(1, c[h]) + m[1] * c[w] / n + m[2] / size) if c[w] else math.log10(m[2] / size)
        assert r.score == pytest.approx(total, rel=1e-9)


def test_a_part_is_sorted_in_pieces():
    import numpy as np

    from tidewire.llm import language_model

    rng = np.random.default_rng(3)
    rows, want, base = [], [], 0
    for flush in range(4):
        keys, local = rng.integers(0, 90_000, 160_000).astype(np.uint64), rng.integers(0, 8, 160_000).astype(np.uint64)
        rows.append((5, flush, 4, language_model._pack(np.sort(keys << np.uint64(4) | local)), language_model._pack(np.arange(8, dtype=np.uint64) * 3), bytes([0, 1] * 4), None, None))
        want += list(zip(keys.tolist(), (local + base).tolist(), (local % 2 == 0).tolist()))
        base += 8
    parts = [(docs, list(pieces)) for docs, pieces in language_model._parts(iter([language_model._rows(rows)]))]
    assert len(parts) == 1 and [f for f, _ in parts[0][0]] == [0, 1, 2, 3]
    pieces = parts[0][1]
    assert len(pieces) == 4 and max(len(k) for k, _, _ in pieces) < 1.1 * language_model.PIECE
    assert sum(len(np.unique(k)) for k, _, _ in pieces) == len({k for k, _, _ in want})
    assert sorted((a, b, c) for k, o, t in pieces for a, b, c in zip(k.tolist(), o.tolist(), t.tolist())) == sorted(want)
