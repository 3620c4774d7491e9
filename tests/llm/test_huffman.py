import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidewire.llm import huffman as H

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(seed=1):
    rng = random.Random(seed)
    parts = ["Hello", "world", "it's", "can't", "'S", "ÉCOLE", "naïve", "×", "÷", "a×b", "x.y,z", "<|endoftext|>", "foo<|startoftext|>bar", "<|", "|>", "Σ", "ΑΣ.b", "é", "é.", ",é", "…", "a….b", "«ou»", "123", "1a2", "日本語", "😀!", " ", " x", "\u0085", "\x00", "\x1c", "don't,won't", "é,", ".́", "--", "_a_", "ﬁ", "İ"]
    out = [None, "", " ", "\n\t", " a ", "<|endoftext|>"]
    return out + ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "  ", "."]) for _ in range(rng.randrange(1, 25))) for _ in range(400)]


def test_ids_are_the_librarys():
    tokenizer, given = Tokenizer.from_file(PATH), texts()
    ids, firsts = H.WordEncoder(PATH).encode(pa.array(given, pa.string()))
    for k, t in enumerate(given):
        assert ids[firsts[k] : firsts[k + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def limited_cost(counts, limit):
    """The least cost over all non-decreasing length sequences that satisfy Kraft's inequality."""
    c = sorted((int(x) for x in counts if x), reverse=True)
    best = {(0, 0): 0}
    for x in c:
        after = {}
        for (low, used), cost in best.items():
            for n in range(max(1, low), limit + 1):
                key = (n, used + (1 << (limit - n)))
                if key[1] <= 1 << limit:
                    after[key] = min(after.get(key, 10**18), cost + n * x)
        best = after
    return min(best.values())


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = rng.zipf(1.4, 40).astype(np.int64) % 10**6 * (rng.random(40) < 0.8)
        n = H.code_lengths(counts, 30)
        assert (n[counts > 0] > 0).all() and (n[counts == 0] == 0).all()
        if (counts > 0).sum() > 1:
            assert (n * counts).sum() == huffman_cost(counts)
    for _ in range(30):
        counts = 2 ** rng.integers(0, 14, 9)
        n = H.code_lengths(counts, 4)
        assert n.max() <= 4 and (2.0 ** -n).sum() <= 1 and (n * counts).sum() == limited_cost(counts, 4)


def test_bits_round_trip():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3000):
        ids = np.minimum(rng.zipf(1.3, 20_000) - 1, size - 1)
        code = H.Code(H.code_lengths(np.bincount(ids)))
        firsts = np.array([0, 0, 1, 700, 700, 15_000, 20_000])
        data, local, at = code.encode(ids, firsts)
        starts, counts = [], []
        for k in range(6):
            for b in range(firsts[k], firsts[k + 1], 64):
                starts.append(8 * at[k] + local[b])
                counts.append(min(64, firsts[k + 1] - b))
        assert code.decode(data, np.array(starts), np.array(counts)).tolist() == ids.tolist()


def test_files(spark, tmp_path):
    given = texts(5)[:120] + ["the of and " * 2000]
    rng = random.Random(0)
    rows = [(i, t, 0) for i, t in enumerate(given)] + [(7, given[7], 0), (None, "a b", 0)]
    shuffled = rng.sample(rows, len(rows))
    docs = spark.createDataFrame(shuffled, "doc_id long, text string, bits int").repartition(5)
    H.write(docs, PATH, str(tmp_path / "x"))
    got = sorted((tuple(r) for r in H.digests(spark, str(tmp_path / "x")).collect()), key=lambda r: r[1])
    tokenizer, at, want = Tokenizer.from_file(PATH), 0, []
    for i, t, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    assert got == want
    H.write(docs.where("false"), PATH, str(tmp_path / "y"))
    assert H.digests(spark, str(tmp_path / "y")).count() == 0


def test_many_rows_of_one_id(spark, tmp_path):
    """A third of the rows have no id: they are several files, and starts still follow on one another."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(None if k % 3 else 5, f"text number {k % 200}") for k in range(900)] + [(9, "last")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        H.write(docs, PATH, str(tmp_path / "x"))
        files = spark.read.parquet(str(tmp_path / "x/ids"))
        assert files.where("doc_id is null").select("part").distinct().count() > 1
        got = sorted((tuple(r) for r in H.digests(spark, str(tmp_path / "x")).collect()), key=lambda r: r[1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r[0] for r in got] == [None] * 600 + [5] * 300 + [9]
    assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])[:-1])).tolist()
    tokenizer = Tokenizer.from_file(PATH)
    assert sorted(r[3] for r in got) == sorted(zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")) for _, t in rows)
