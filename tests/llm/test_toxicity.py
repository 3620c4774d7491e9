import random
import zlib

import numpy as np

from tidewire.llm import toxicity as T


def slow_kernel(s, t, n=3, decay=0.8):
    """All pairs of index tuples."""
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), n):
        for j in combinations(range(len(t)), n):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_matches_all_subsequences():
    rng = random.Random(1)
    for _ in range(60):
        s, t = (bytes(rng.choices(b"abc", k=rng.randrange(1, 9))) for _ in range(2))
        x, nx = T.padded([s, s])
        y, ny = T.padded([t, t], 10)
        assert np.allclose(T.subsequence_kernel(x, nx, y, ny), slow_kernel(s, t))


def made(n=400, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("aeionrstlh", k=rng.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randrange(5, 60))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron,", "Stupid"]))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    return rows, labels, vocab


def test_held_out_accuracy_and_inserted_characters(spark):
    rows, labels, vocab = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    got = T.toxicity(docs, marks).select("doc_id", "score", "predicted").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    clean = " ".join(vocab[:20])
    odd = ["you i.d.i.o.t " + clean, clean + " id-iot", clean + " m o r o n", "x" * 4000 + "stupid" + "x" * 300, clean, "", None]
    out = T.toxicity(docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")), marks)
    score = {r.doc_id: r.score for r in out.where("doc_id >= 1000").collect()}
    assert min(score[1000 + i] for i in range(4)) > 0.5 > max(score[1000 + i] for i in (4, 5, 6))


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels, _ = made(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a, b = ([tuple(r) for r in T.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id").collect()] for x in (labels, flipped))
    assert a == b


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = T.toxicity(docs, none).collect()
    assert len(got) == 3 and all(r.score == 0.5 and r.predicted == 0 for r in got)
    assert T.toxicity(docs.where("false"), none).count() == 0
    one = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in T.toxicity(docs, one).collect())
