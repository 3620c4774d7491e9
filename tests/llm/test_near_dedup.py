import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from tidewire.llm import near_dedup as N


def plain(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jp(x, y):
    kinds = Counter((x[d], y[d]) for d in x.keys() | y.keys())
    return sum(n / sum(m * max(c / a, d / b) for (c, d), m in kinds.items()) for (a, b), n in kinds.items() if a and b)


def made(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    texts = []
    for _ in range(30):
        w = rng.choices(vocab, k=rng.choice([3, 8, 60, 200]))
        texts.append(" ".join(w))
        for _ in range(rng.randrange(3)):
            v = list(w)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append(" ".join(v))
    return texts + [None, "", "", "...", texts[0], texts[0].upper()]


def test_similarity_matches_the_definition():
    texts = made()
    h, c, f = N.weighted(pa.array(texts, pa.string()))
    for i in range(0, len(texts) - 6, 2):
        for j in range(i, min(i + 4, len(texts))):
            a, b = slice(f[i], f[i + 1]), slice(f[j], f[j + 1])
            x, y = plain(texts[i]), plain(texts[j])
            got = N.similarity(h[a], c[a], h[b], c[b])
            if x and y:
                assert got == pytest.approx((jp(x, y), len(x & y) and len(x.keys() & y.keys()) / len(x.keys() | y.keys())))


def test_registers_estimate_the_probability_jaccard():
    rng = random.Random(5)
    base = [f"a{rng.randrange(10**6)}" for _ in range(400)]
    other = base[:300] + [f"b{rng.randrange(10**6)}" for _ in range(100)]
    x, y = " ".join(base), " ".join(other)
    h, c, f = N.weighted(pa.array([x, y]))
    s = N.sketches(h, c, f, 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(jp(plain(x), plain(y)), abs=0.03)
    assert np.array_equal(N.sketches(h, c, f, 64), N.sketches(h, c, f, 64))


def test_classes_match_brute_force(spark):
    texts = made(3)
    rows = [Row(doc_id=i, text=t, bands="clash", fp=1) for i, t in enumerate(texts)]
    members, links = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, bands string, fp int"))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [plain(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            x, y = bags[i], bags[j]
            same = (texts[i] or "") == (texts[j] or "")
            if same or (x and y and max(jp(x, y), len(x.keys() & y.keys()) / len(x.keys() | y.keys())) >= 0.8):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r.doc_id: r.class_id for r in members.collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert all(r.a < r.b and max(r.similarity, r.jaccard) >= 0.8 for r in links.collect())


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    members, links = N.near_duplicates(spark.createDataFrame([], schema))
    assert members.count() == 0 and links.count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "")]
    members, _ = N.near_duplicates(spark.createDataFrame(rows, schema))
    got = sorted(members.collect(), key=str)
    assert len(got) == 5 and {r.class_id for r in got if r.doc_id in (2, 3)} == {2}
    kept = N.deduplicated(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 3]


def test_texts_that_differ_in_repeats_only_are_found(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        block, rest = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (20, 60))
        rows += [(2 * g, " ".join(block * 50 + rest)), (2 * g + 1, " ".join(block * 3 + rest))]
    members, links = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: i - i % 2 for i in range(24)}
    assert all(r.similarity < 0.6 and r.jaccard >= 0.8 for r in links.collect())


def test_one_row_of_each_class_stays_where_ids_repeat(spark):
    words = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(1, words("a")), (1, words("b")), (2, words("b")), (2, words("c")), (None, words("d")), (None, words("d") + " x"), (None, words("e")), (3, words("d"))]
    got = N.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in got) == [(0, "d"), (0, "e"), (1, "a"), (1, "b"), (2, "c"), (3, "d")]


def crowd(n, repeats):
    """n different near copies of one text, from nearly equal to hardly alike, and whether lines repeat in them."""
    rng = random.Random(11 + repeats)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    line = [f"l{rng.randrange(10**6)}" for _ in range(8)]
    texts = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 3])] = [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 2]))]
        texts.append(" ".join(w + line * (rng.choice([4, 4, 5]) if repeats else 0)))
    return texts


def roots(bags, threshold=0.8):
    parent = list(range(len(bags)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = []
    for i in range(len(bags)):
        for j in range(i):
            x, y = bags[i], bags[j]
            if max(len(x.keys() & y.keys()) / len(x.keys() | y.keys()), jp(x, y)) >= threshold:
                linked.append((j, i))
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(bags))], linked


@pytest.mark.parametrize("repeats", [0, 1])
def test_blocks_of_one_bucket_give_the_classes_of_all_pairs(spark, repeats):
    texts = crowd(70, repeats)
    bags = [plain(t) for t in texts]
    want, _ = roots(bags)
    assert len(set(want)) > 3
    names = [bytes([i]) for i in range(len(texts))]
    apart = spark.createDataFrame([(1, f, f, True) for f in names], "key long, fp binary, label binary, left boolean")
    nodes = spark.createDataFrame(list(zip(names, texts)), "fp binary, text string")
    cells = N._cells(apart, nodes, 20, 1 << 20)
    assert {(r.i, r.j) for r in cells.select("i", "j").distinct().collect()} == {(i, j) for j in range(4) for i in range(j + 1)}
    got = cells.groupBy("key", "i", "j").applyInArrow(N._met(0.8), "a binary, b binary, similarity double, jaccard double").collect()
    assert len(got) < 10 * len(texts)
    assert all(max(r.similarity, r.jaccard) >= 0.8 for r in got)
    group = {f: i for i, f in enumerate(names)}
    for _ in names:
        for r in got:
            group[bytes(r.a)] = group[bytes(r.b)] = min(group[bytes(r.a)], group[bytes(r.b)])
    assert [group[f] for f in names] == want


def test_recall_in_a_large_group_of_near_copies(spark):
    texts = crowd(150, 1)
    want, linked = roots([plain(t) for t in texts])
    members, _ = N.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r.class_id for r in members.collect()}
    assert sum(got[i] == got[j] for i, j in linked) >= 0.99 * len(linked)
    assert all(want[i] == want[c] for i, c in got.items())
