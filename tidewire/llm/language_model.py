"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

p(w | h) = l2 c(h, w) / c(h) + l1 c(w) / N + l0 / V, with weights by the bucket log2 c(h) of the context's count.  The weights
are learned by expectation-maximisation on held-out counts: each training bigram is predicted from the
counts without itself, (c(h, w) - 1) / (c(h) - 1) and (c(w) - 1) / (N - 1).

Every training word is a word of the model, and words that training lacks are one more, without counts.  A text is
preceded and closed by the end token.

Words are 64-bit hashes.  The HEAD most frequent ones have ids that all tasks know.  Their bigram occurrences are shuffled
by key in packed blocks, so that counts meet the texts that need them; pairs of the HOT most frequent words, which could be
many of all tokens, are instead counted in a dense table and scored where the texts are read.  Bigrams with a word outside
the head are rows that meet the word's count, and each other, by a join on the word.  All take the same counts and weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import kernels as K

U64 = np.uint64
END = U64(0xE4D0F7E47)
HEAD, HOT = 1 << 20, 1024
PAD = 0.1
FLUSH = 800_000
#: Occurrences of a part that are sorted at once; only memory depends on it.
PIECE = 200_000
ID_BITS = 21
BUCKETS, QUARTERS = 24, 4


@dataclass
class Words:
    """The head words: sorted hashes, their ids by falling count (the end token is one), counts by id; id len(counts) - 1 is any other word.

    total and distinct are of all training tokens; size is the number of words of the model.
    """

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    size: int

    @property
    def other(self) -> int:
        return len(self.counts) - 1


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, joined, each text closed by the end token, and per text the index of its first."""
    data, offsets = K.buffers(column)
    starts, ends, firsts = K.words(data, offsets, K.VISIBLE)
    hashes = np.insert(K.span_hashes(data, starts, ends), firsts[1:], END)
    return hashes, firsts + np.arange(len(firsts))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batches, "text"):
        words, n = np.unique(tokens(part.column("text"))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the count of each distinct token of training documents (text), by its hash."""
    rows = docs.where("not held_out").select("text")
    return K.kept(rows.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def head(counts: DataFrame, size: int = HEAD) -> Words:
    """The words whose count reaches the least threshold that at most size words reach, and the end token."""
    by = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    levels = by.orderBy(F.desc("n")).toLocalIterator()
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    taken, least = 0, None
    for r in levels:
        if taken + r.k > size:
            break
        taken, least = taken + r.k, r.n
    end = F.col("word") == int(END.view(np.int64))
    rows = counts.where((F.col("n") >= (least if least is not None else 2**62)) | end).toArrow()
    words, n = rows.column("word").to_numpy().view(U64), rows.column("n").to_numpy()
    grand, distinct = int(total.n or 0), int(total.v or 0)
    if END not in words:
        words, n = np.append(words, END), np.append(n, 0)
    order = np.lexsort((words, -n))
    words, n = words[order], n[order]
    by_hash = np.argsort(words)
    return Words(words[by_hash], by_hash.astype(np.int32), np.append(n, 0), grand, distinct, max(1, distinct) + 1)


def bigrams(words: Words, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context ids, word ids, owners) of all tokens."""
    at = K.membership(hashes, words.hashes)
    ids = np.where(at >= 0, words.ids[at], words.other).astype(np.int64)
    before = np.empty_like(ids)
    if len(ids):
        before[1:] = ids[:-1]
        before[firsts[:-1]] = words.ids[K.membership(np.array([END]), words.hashes)[0]]
    return before, ids, K.owners(firsts)


def _pack(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, byte plane by byte plane."""
    gaps = np.diff(x, prepend=U64(0))
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def _names(column: pa.Array) -> np.ndarray:
    """Names of 16 bytes as pairs of integers."""
    return K.buffers(column)[0].view(np.int64).reshape(-1, 2)


def _blocks(shared, parts: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        hot = np.zeros(HOT * HOT, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rids: list[np.ndarray] = []
        flags: list[np.ndarray] = []
        size = docs = 0

        def flush():
            keys, owner = (np.concatenate(x) for x in zip(*held))
            ids, out = np.concatenate(rids), np.concatenate(flags)
            # the same whenever this task runs again, and another for the same texts in another order
            name = int(K.mix(ids.view(U64).ravel() + np.arange(1, ids.size + 1, dtype=U64) * K.GOLDEN).sum(dtype=U64).view(np.int64))
            part = (K.mix(keys) % U64(parts)).astype(np.int64)
            bits = max(1, int(len(ids)).bit_length())
            occ = (keys << U64(bits)) | owner.astype(U64)
            order = np.lexsort((occ, part))
            occ, part = occ[order], part[order]
            edge = np.searchsorted(part, np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(edge)):
                x = occ[edge[p] : edge[p + 1]]
                local, where = np.unique((x & U64((1 << bits) - 1)).astype(np.int64), return_inverse=True)
                few = max(1, len(local).bit_length())
                rows.append((int(p), name, few, _pack(np.sort(((x >> U64(bits)) << U64(few)) | where.astype(U64))), _pack(local.astype(U64)), out[local].tobytes(), None, None))
            rows.append((-1 - name % parts, name, 0, b"", ids.tobytes(), b"", None, None))
            return _rows(rows)

        for part in K.slices(batches, "text"):
            hashes, firsts = tokens(part.column("text"))
            h, w, owner = bigrams(words, hashes, firsts)
            out = part.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8)
            head = (h != words.other) & (w != words.other)
            both = (h < HOT) & (w < HOT) & head
            own = head & ~both
            some = both & (out[owner] == 0)
            hot += np.bincount(h[some] * HOT + w[some], minlength=HOT * HOT)
            held.append(((h[own].astype(U64) << U64(ID_BITS)) | w[own].astype(U64), owner[own] + docs))
            rids.append(_names(part.column("rid")))
            flags.append(out)
            size, docs = size + int(own.sum()), docs + part.num_rows
            if size >= FLUSH:
                yield flush()
                held, rids, flags, size, docs = [], [], [], 0, 0
        if size:
            yield flush()
        used = np.flatnonzero(hot)
        if len(used):
            yield _rows([(-1 - int(hot[used].sum()) % parts, 0, -1, b"", b"", b"", used.tolist(), hot[used].tolist())])

    return blocks


#: Rows of three kinds: a part's occurrences of one flush (part from 0), a flush's texts (bits 0), and a task's hot pairs (bits -1).
BLOCK = "part int, flush long, bits int, occ binary, docs binary, out binary, pairs array<long>, pair_counts array<long>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "flush", "bits", "occ", "docs", "out", "pairs", "pair_counts"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, np.ndarray]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """([(flush, its texts' places)], its pieces) of each part in turn; rows come sorted by part.

    A piece is (bigrams, their owners, whether they are for training), with all occurrences of its bigrams and about PIECE in all.
    """
    now, rows = None, []

    def joined():
        held, docs, base = [], [], 0
        for flush, bits, occ, places, flags in rows:
            held.append((_unpack(occ), U64(bits), base, np.frombuffer(flags, np.uint8)))
            docs.append((flush, _unpack(places)))
            base += len(docs[-1][1])
        rows.clear()
        return docs, pieces(held)

    def pieces(held):
        n = U64(max(1, -(-sum(len(x) for x, *_ in held) // PIECE)))
        for k in range(int(n)):
            keys, owners, out = [], [], []
            for x, bits, base, flags in held:
                if n > 1:
                    x = x[K.mix((x >> bits) + K.GOLDEN) % n == k]  # parts are dealt by mix of the key itself
                keys.append((x >> bits).astype(np.int64))
                local = (x & ((U64(1) << bits) - U64(1))).astype(np.int64)
                owners.append(local + base)
                out.append(flags[local] == 0)
            keys, owners, out = np.concatenate(keys), np.concatenate(owners), np.concatenate(out)
            if len(keys):
                yield keys, owners, out
        K.release()

    for batch in batches:
        for r in batch.to_pylist():
            if r["part"] != now and rows:
                yield joined()
                rows = []
            now = r["part"]
            rows.append((r["flush"], r["bits"], r["occ"], r["docs"], r["out"]))
    if rows:
        yield joined()


def _log_cell(f: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(f > 0, np.round(QUARTERS * np.log2(np.maximum(f, 1e-30))), -1000).astype(np.int64)


def counts_of(words: Words, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts of the contexts and words of pairs of head words."""
    return words.counts[keys >> ID_BITS], words.counts[keys & ((1 << ID_BITS) - 1)]


def held_out_cells(total: int, c_h: np.ndarray, c_w: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket, bigram cell, unigram cell, weight, weighted bigram and unigram estimates) of bigrams seen n times, without themselves."""
    f2, f1 = np.where(c_h > 1, (n - 1) / np.maximum(c_h - 1, 1), 0.0), (c_w - 1) / max(1, total - 1)
    cell = np.stack([bucket(c_h), _log_cell(f2), _log_cell(f1)], 1)
    unique, which = np.unique(cell, axis=0, return_inverse=True)
    which = which.ravel()
    return (*unique.T, *(np.bincount(which, v, len(unique)) for v in (weight.astype(float), weight * f2, weight * f1)))


def bucket(context_counts: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.log2(np.maximum(context_counts, 1)).astype(np.int64))


CELLS = "b long, x long, y long, n double, s2 double, s1 double"


def _cell_rows(got: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in got[:3]), *(pa.array(c, pa.float64()) for c in got[3:])], ["b", "x", "y", "n", "s2", "s1"])


def _cells(shared):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for _, pieces in _parts(batches):
            for keys, _, train in pieces:
                unique, n = np.unique(keys[train], return_counts=True)
                if len(unique):
                    yield _cell_rows(held_out_cells(words.total, *counts_of(words, unique), n, n))

    return cells


RARE = "t long, o long, c_o long, side boolean, rid binary, train boolean, k long"


def _rare(shared):
    """Bigrams with a word outside the head, k times in a text: t is such a word, the context where side holds, and o the
    bigram's other word with its count, or -1 where it is outside the head too."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for part in K.slices(batches, "text"):
            hashes, firsts = tokens(part.column("text"))
            h, w, owner = bigrams(words, hashes, firsts)
            before = np.roll(hashes, 1)
            before[firsts[:-1]] = END
            at = np.flatnonzero((h == words.other) | (w == words.other))
            h, w, before, hashes, owner = h[at], w[at], before[at], hashes[at], owner[at]
            order = np.lexsort((hashes, before, owner))
            new = np.ones(len(order), bool)
            new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (hashes, before, owner)], axis=0)
            edge = np.flatnonzero(new)
            at, k = order[edge], np.diff(np.append(edge, len(order)))
            side = h[at] == words.other
            t, o = np.where(side, before[at], hashes[at]), np.where(side, hashes[at], before[at])
            c_o = np.where(side, np.where(w[at] == words.other, -1, words.counts[w[at]]), words.counts[h[at]])
            texts = pa.array(owner[at])
            columns = [pa.array(t.view(np.int64)), pa.array(o.view(np.int64)), pa.array(c_o.astype(np.int64)), pa.array(side), part.column("rid").take(texts), pa.compute.invert(part.column("held_out").take(texts)), pa.array(k.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["t", "o", "c_o", "side", "rid", "train", "k"])

    return rare


def rare_bigrams(rows: DataFrame, shared, counts: DataFrame) -> DataFrame:
    """(rid, train, k, n, c_h, c_w, rare) of the bigrams of RARE: training has them n times and their words c_h and c_w times; rare where the second word is outside the head."""
    found = rows.mapInArrow(_rare(shared), RARE).join(counts.select(F.col("word").alias("t"), F.col("n").alias("c")), "t", "left")
    n = F.sum(F.when(F.col("train"), F.col("k")).otherwise(0)).over(Window.partitionBy("t", "o", "side"))
    found = found.select("rid", "train", "k", n.alias("n"), F.coalesce("c", F.lit(0)).alias("c"), "c_o", "side", F.when(F.col("c_o") < 0, F.col("o")).alias("o"))
    found = K.kept(found, "rare")
    two = found.where("c_o < 0").join(counts.select(F.col("word").alias("o"), F.col("n").alias("second")), "o", "left")
    two = K.kept(two.select("rid", "train", "k", "n", F.col("c").alias("c_h"), F.coalesce("second", F.lit(0)).alias("c_w"), F.lit(True).alias("rare")), "rare")
    one = found.where("c_o >= 0").select("rid", "train", "k", "n", F.when(F.col("side"), F.col("c")).otherwise(F.col("c_o")).alias("c_h"), F.when(F.col("side"), F.col("c_o")).otherwise(F.col("c")).alias("c_w"), (~F.col("side")).alias("rare"))
    return one.unionByName(two)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _rare_cells(total: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c_h, c_w, n, k = _numbers(batch, "c_h", "c_w", "n", "k")
                yield _cell_rows(held_out_cells(total, c_h, c_w, n, k))

    return cells


def _rare_scores(mix: np.ndarray, total: int, distinct: int, size: int):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.log10(total + PAD * (distinct + 1))
        for batch in batches:
            c_h, c_w, n, k, rare = _numbers(batch, "c_h", "c_w", "n", "k", "rare")
            score = k * log_probability(total, size, mix, c_h, c_w, n)
            base = np.where(rare, k * (np.log10(c_w + PAD) - scale), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(score, pa.float64()), pa.array(base, pa.float64()), pa.array(np.where(rare & (c_w > 0), k, 0), pa.int64())], ["rid", "part_score", "tail_base", "tail_known"])

    return scores


def expectation_maximisation(f: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Mixture weights of the columns of f that maximise the likelihood of its rows, seen n times."""
    w = start
    for _ in range(rounds):
        share = f * w
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        after = (n[:, None] * share).sum(axis=0) / n.sum()
        if np.abs(after - w).max() < 1e-9:
            break
        w = after
    return after


def weights(words: Words, cells: list[tuple]) -> np.ndarray:
    """(BUCKETS, 3) weights from (bucket, x, y, n, s2, s1) rows; a bucket without any has those of all buckets."""
    third = np.full(3, 1 / 3)
    out = np.tile(third, (BUCKETS, 1))
    if not cells:
        return out
    x = np.array(sorted(cells), float)
    f = np.stack([x[:, 4] / x[:, 3], x[:, 5] / x[:, 3], np.full(len(x), 1 / words.size)], 1)
    out[:] = expectation_maximisation(f, x[:, 3], third)
    for b in range(BUCKETS):
        own = x[:, 0] == b
        if own.any():
            out[b] = expectation_maximisation(f[own], x[own, 3], third)
    # every event keeps some probability
    return (out + 1e-6) / (out + 1e-6).sum(axis=1, keepdims=True)


def log_probability(total: int, size: int, mix: np.ndarray, c_h: np.ndarray, c_w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 p(w | h) of words seen c_h and c_w times, with bigram counts n."""
    m = mix[bucket(c_h)]
    return np.log10(m[:, 0] * n / np.maximum(c_h, 1) + m[:, 1] * c_w / max(1, total) + m[:, 2] / size)


PART_SCORES = "flush long, docs binary, scores binary"


def _bigram_scores(shared, mix: np.ndarray):
    """A row for each part and flush: places of texts, and the sums of their log probabilities in that part."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for docs, pieces in _parts(batches):
            edges = np.cumsum([0, *(len(x) for _, x in docs)])
            total = np.zeros(edges[-1])
            for keys, owner, train in pieces:
                unique, which = np.unique(keys, return_inverse=True)
                n = np.bincount(which[train], minlength=len(unique))
                value = log_probability(words.total, words.size, mix, *counts_of(words, unique), n)
                total += np.bincount(owner, value[which], edges[-1])
            columns = [[f for f, _ in docs], [_pack(x) for _, x in docs], [total[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], ["flush", "docs", "scores"])

    return scores


def _flush_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, part_score) from the rows of each flush in turn, sorted by flush; the row without scores names its texts."""

    def summed(rows):
        names = next(np.frombuffer(d, np.int64).reshape(-1, 2) for d, x in rows if x is None)
        total = np.zeros(len(names))
        for d, x in rows:
            if x is not None:
                total[_unpack(d).astype(np.int64)] += np.frombuffer(x, np.float64)
        ids, where = np.unique(names, axis=0, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(np.bincount(where.ravel(), total, len(ids)), pa.float64())], ["rid", "part_score"])

    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["flush"] != now and rows:
                yield summed(rows)
                rows = []
            now = r["flush"]
            rows.append((r["docs"], r["scores"]))
    if rows:
        yield summed(rows)


def _text_scores(shared, grid):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot = shared.value, grid.value
        scale = np.log10(words.total + PAD * (words.distinct + 1))
        base = np.log10(words.counts + PAD) - scale
        for part in K.slices(batches, "text"):
            hashes, firsts = tokens(part.column("text"))
            h, w, owner = bigrams(words, hashes, firsts)
            n = part.num_rows
            both, known, head = (h < HOT) & (w < HOT) & (h != words.other) & (w != words.other), words.counts[w] > 0, w != words.other
            score = np.bincount(owner[both], hot[h[both] * HOT + w[both]], n)
            plain = np.bincount(owner[head], base[w[head]], n)
            columns = [part.column("doc_id"), part.column("rid"), part.column("held_out"), pa.array(np.diff(firsts), pa.int64()), pa.array(np.bincount(owner[known], minlength=n), pa.int64()), pa.array(plain, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rid", "held_out", "n_tokens", "n_known", "base", "score"])

    return scores


def score_texts(docs: DataFrame, held_out, head_size: int = HEAD) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    held_out is a Column: the model learns from the rows where it is false.  A null or empty text is one end token.
    Repeated rows get equal scores, and are all returned; null ids too.  Other columns are ignored.  Without
    training rows nothing is known, and the base gives each token the same probability.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    # a row's name: 128 bits of its id and text, so that no two rows that differ are taken for one
    rows = rows.withColumn("rid", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text").cast("binary"))))
    counts = word_counts(rows)
    words = head(counts, head_size)
    # the only copy of the words that a worker holds; a reused one keeps every broadcast that it has met
    shared = spark.sparkContext.broadcast(words)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.total // 4_000_000))
    blocks = rows.mapInArrow(_blocks(shared, parts), BLOCK).repartition(parts, "part").sortWithinPartitions("part")
    path = K.shared_path(spark, "bigrams")
    # one file a part and one row group a file, so that no part is read by two tasks: a part holds some 4 million tokens
    blocks.write.option("parquet.block.size", 1 << 30).option("maxRecordsPerFile", 0).option("compression", "none").parquet(path)
    blocks = spark.read.schema(BLOCK).parquet(path)
    pairs = blocks.where("part >= 0").select("part", "flush", "bits", "occ", "docs", "out")
    hot = np.zeros(HOT * HOT, np.int64)
    dense = blocks.where("bits = -1").select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p")).groupBy("p.pairs").agg(F.sum("p.pair_counts").alias("n")).toArrow()
    hot[dense.column("pairs").to_numpy()] = dense.column("n").to_numpy()  # at most HOT * HOT rows
    rare = rare_bigrams(rows, shared, counts)
    cells = pairs.mapInArrow(_cells(shared), CELLS).unionByName(rare.where("train").mapInArrow(_rare_cells(words.total), CELLS)).groupBy("b", "x", "y").agg(*(F.sum(c).alias(c) for c in ("n", "s2", "s1"))).collect()
    used = np.flatnonzero(hot)
    more = held_out_cells(words.total, words.counts[used // HOT], words.counts[used % HOT], hot[used], hot[used]) if len(used) else []
    mix = weights(words, [*(tuple(r) for r in cells), *zip(*(c.tolist() for c in more))])
    ids = min(HOT, len(words.counts))
    grid = np.zeros((HOT, HOT))
    h, w = (x.ravel() for x in np.meshgrid(np.arange(ids), np.arange(ids), indexing="ij"))
    grid[h, w] = log_probability(words.total, words.size, mix, words.counts[h], words.counts[w], hot.reshape(HOT, HOT)[h, w])

    kind = "doc_id long, rid binary, held_out boolean, n_tokens long, n_known long, base double, score double"
    own = K.kept(rows.mapInArrow(_text_scores(shared, spark.sparkContext.broadcast(grid.ravel())), kind), "scores")
    scored = pairs.mapInArrow(_bigram_scores(shared, mix), PART_SCORES)
    named = blocks.where("part < 0 and bits = 0").select("flush", "docs", F.lit(None).cast("binary").alias("scores"))
    partial = scored.unionByName(named).repartition(parts, "flush").sortWithinPartitions("flush").mapInArrow(_flush_scores, "rid binary, part_score double")
    copies = own.groupBy("rid").agg(F.count(F.lit(1)).alias("copies"))
    tail = rare.mapInArrow(_rare_scores(mix, words.total, words.distinct, words.size), "rid binary, part_score double, tail_base double, tail_known long")
    none = partial.select("rid", "part_score", F.lit(0.0).alias("tail_base"), F.lit(0).cast("long").alias("tail_known"))
    added = none.unionByName(tail).groupBy("rid").agg(*(F.sum(c).alias(c) for c in ("part_score", "tail_base", "tail_known")))
    added = added.join(copies, "rid").select("rid", "part_score", "tail_base", "tail_known", "copies")
    out = own.join(added, "rid", "left")
    zero = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0))  # noqa: E731  equal rows were summed
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("tail_known").cast("long")).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") + zero("tail_base")).alias("base_score"), (F.col("score") + zero("part_score")).alias("score"))


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document by a model of those whose crc32(doc_id as text) mod 10 isn't 0; a null id is held out."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
