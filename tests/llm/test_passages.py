import random

import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import kernels as K
from tidewire.llm import passages as P


def test_windows_are_those_of_the_cartesian_tree():
    rng = random.Random(2)
    for _ in range(40):
        sizes = [rng.randrange(0, 40) for _ in range(4)]
        hashes = np.array([rng.randrange(30) for _ in range(sum(sizes))], np.uint64)
        firsts = np.concatenate(([0], np.cumsum(sizes)))
        for least in (1, 3, 8):
            value, owner, left, at, right = P.compact_windows(hashes, firsts, 1, least)
            got = {(int(o), int(x), int(k), int(r)) for o, x, k, r in zip(owner, left, at, right)}
            want = set()
            for d in range(4):
                h = K.mix(hashes[firsts[d] : firsts[d + 1]] + np.array([2], np.uint64) * K.GOLDEN).tolist()

                def grow(lo, hi):
                    if hi - lo + 1 >= least:
                        k = min(range(lo, hi + 1), key=lambda i: (h[i], i))
                        want.add((d, lo, k, hi))
                        grow(lo, k - 1)
                        grow(k + 1, hi)

                grow(0, len(h) - 1)
            assert got == want


def test_every_stretch_of_21_shingles_has_a_least_run():
    rng = np.random.default_rng(4)
    hashes, firsts = rng.integers(0, 2**63, 500).astype(np.uint64), np.array([0, 100, 110, 500])
    _, begins, least = P.least_runs(hashes, firsts)
    for a, b in zip(begins[:-1], begins[1:]):
        assert all(least[k : k + P.NEXT].any() for k in range(a, b - P.NEXT + 1))
    assert P.SHORT + P.NEXT - 1 == 21


def test_ranges():
    f, s, e = (np.array(x) for x in ([0, 0, 1, 2], [0, 60, 10, 100], [50, 200, 120, 300]))
    assert P.covered(f, s, e, 2, 40) == [(10, 50), (60, 120), (100, 200)] or P.covered(f, s, e, 2, 40) == [(10, 50), (60, 200)]
    assert P.segments(np.array([1] * 30 + [0] * 5 + [1] * 30 + [0] * 60 + [1] * 10, bool)) == [(0, 65)]


def made():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    text = lambda n: [word() for _ in range(n)]
    passage, line, long_one = text(60), text(12), text(150)
    docs = {}
    for i in range(40):
        w = text(rng.randrange(60, 200)) + line
        if i % 8 == 0:
            w[30:30] = passage
        if i % 13 == 1:
            v = list(long_one)
            v[rng.randrange(150)] = "CHANGED"
            w[10:10] = v
        docs[i] = " ".join(w)
    return docs, {i for i in docs if i % 8 == 0}, {i for i in docs if i % 13 == 1}


def linked(rows):
    group = {}
    for r in rows:
        a, b = group.setdefault(r.doc_id, {r.doc_id}), group.setdefault(r.other_id, {r.other_id})
        if a is not b:
            a |= b
            for x in b:
                group[x] = a
    return {frozenset(g, ) for g in map(frozenset, group.values())}


def test_planted_passages_are_found_and_clean_documents_left(spark):
    docs, exact, near = made()
    rows = [(i, t, 0) for i, t in docs.items()] + [(100, docs[8], 0), (101, docs[3], 0), (102, "short copy", 0), (103, "short copy", 0), (104, None, 0), (105, "", 0), (8, docs[8], 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    got = P.shared_passages(frame).collect()
    assert linked(got) == {frozenset(exact | {100}), frozenset(near), frozenset({3, 101})} or linked(got) == {frozenset(exact | near | {100}), frozenset({3, 101})}
    for r in got:
        if r.kind == "passage":
            assert r.similarity >= 0.8 and r.end - r.start >= 50
            a, b = docs[r.doc_id].lower().split()[r.start : r.end], docs[r.other_id].lower().split()[r.other_start : r.other_end]
            x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
            assert len(x & y) / len(x | y) >= 0.8
    assert P.shared_passages(frame.where("false")).count() == 0


def test_texts_that_hold_the_minima_elsewhere_steal_no_link(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = [word() for _ in range(60)]
    hashes, firsts = P.shingle_hashes(pa.array([" ".join(passage)]))
    spots = sorted({int(k) for f in range(P.FUNCTIONS) for k in P.compact_windows(hashes, firsts, f)[3]})
    rows = [(i, " ".join([word() for _ in range(90)] + passage + [word() for _ in range(70 + i)])) for i in range(2)]
    for i in range(12):  # some have lesser hashes than both
        thief = [word() for _ in range(60)]
        for k in spots:
            thief += passage[k : k + 5] + [word() for _ in range(60)]
        rows.append((10 + i, " ".join(thief)))
    got = P.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got} <= {(0, 1), (1, 0)} and got
    assert all(r.end - r.start >= 60 and r.similarity == 1.0 for r in got)


def test_all_exact_passages_are_in_one_class(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    stock = [[word() for _ in range(n)] for n in (52, 60, 75, 120, 30, 12)]
    docs = {}
    for i in range(160):
        w = [word() for _ in range(rng.randrange(40, 160))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(stock)
            n = rng.randrange(8, len(s) + 1)
            at, to = rng.randrange(len(w)), rng.randrange(len(s) - n + 1)
            w[at:at] = s[to : to + n]
        docs[i] = w
    runs = {}
    for i, w in docs.items():
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {(min(v), x) for v in runs.values() for x in v if x != min(v)}
    got = P.shared_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()
    classes = linked(got)
    assert len(want) > 10
    assert all(any(a in c and b in c for c in classes) for a, b in want)


def test_a_hot_passage_and_a_very_long_text(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = [word() for _ in range(58)]
    docs = [[word() for _ in range(rng.randrange(30, 60))] + passage + [word() for _ in range(20)] for _ in range(150)]
    docs.append([word() for _ in range(20_000)] + passage + [word() for _ in range(10_000)] + passage)
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)] + [(1000, None), (1001, " ".join(word() for _ in range(30_000)))]
    got = P.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert linked(got) == {frozenset(range(len(docs)))}
    assert len(got) <= 4 * len(docs) and all(r.end - r.start >= 50 for r in got)


@pytest.mark.parametrize("words,edits,quoters,shortest", [(60, 1, 4, 45), (100, 2, 8, 45), (80, 1, 6, 30), (150, 3, 8, 48), (60, 1, 0, 45)])
def test_near_passages_among_texts_that_quote_parts_of_them(spark, words, edits, quoters, shortest):
    """Of 50 pairs with an edited passage, whose parts of up to 48 words others quote, nine in ten or more are linked."""
    rng = random.Random(words + quoters)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    text = lambda n: [word() for _ in range(n)]
    rows, pairs, close = [], [], 0
    for _ in range(50):
        passage = text(words)
        edited = list(passage)
        for e in range(edits):
            edited[(2 * e + 1) * words // (2 * edits) + rng.randrange(-4, 5)] = word()
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (passage, edited))
        close += len(x & y) / len(x | y) >= 0.8
        pairs.append((len(rows), len(rows) + 1))
        for own in (passage, edited):
            rows.append(text(rng.randrange(60, 120)) + own + text(rng.randrange(60, 120)))
        for _ in range(quoters):
            n = rng.randrange(shortest, 49)
            at = rng.randrange(words - n + 1)
            rows.append(text(rng.randrange(60, 120)) + passage[at : at + n] + text(rng.randrange(60, 120)))
    order = list(range(len(rows)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, " ".join(rows[i])) for i in order], "doc_id long, text string")
    got = P.shared_passages(docs).collect()
    classes = {}
    for g in linked(got):
        classes.update(dict.fromkeys(g, g))
    assert close == 50 and sum(b in classes.get(a, ()) for a, b in pairs) >= 45
    assert all(r.similarity >= 0.8 and r.end - r.start >= 50 for r in got)
