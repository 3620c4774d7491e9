import hashlib
import random
import re

from tidewire.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for key, item in items:
        v = words(item)
        n = min(10, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(key))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["a", "b", "é1", "d", "Zz"]
    items = [(i, "  ".join(rng.choices(vocab, k=rng.choice([3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(20, None), (21, "..."), (22, items[3][1]), (22, items[4][1])]
    docs = [(i, ", ".join(rng.choices(vocab, k=rng.choice([0, 2, 40, 300])))) for i in range(40)]
    docs += [(100 + i, "x y z " + t.upper() + " q") for i, t in items if t] + [(None, None), (7, ""), (7, "")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((d, *brute(t, items)) for d, t in docs), key=str)
    assert sorted((tuple(r) for r in D.contamination(frame, bench).collect()), key=str) == want
    # the same from many small automata
    assert sorted((tuple(r) for r in D.contamination(frame, bench, max_words=20).collect()), key=str) == want


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.n_hit for r in D.contamination(docs, none).collect()] == [0]
    assert D.contamination(docs.where("false"), none).count() == 0


def test_spans_are_cut_and_full_copies_dropped(spark):
    item = " ".join(f"q{i}" for i in range(14))
    rows = [(1, "é before now then so far " + item + " after", 5, "x"), (2, item, 5, "x"), (3, "clean é", 99, "y"), (4, None, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, clean string")
    got = {r.doc_id: r for r in D.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3, 4} and got[1].text == "é before now then so far  after" and got[1].n_chars == 31
    assert got[3].text == "clean é" and got[3].n_chars == 99 and got[4].text is None and got[1].clean == "x"
