"""MinHash near-deduplication by ProbMinHash.

A text is a multiset of shingles of five words (lower-cased A-Z; words of ASCII letters, digits and bytes
from 128).  Each distinct shingle is a Poisson process whose rate is its count; each arrival falls into one
of the registers at random, and a register keeps the shingle that arrives first.  An element stops as soon
as its next arrival is later than the latest register (early termination).  The share of equal registers
estimates the probability Jaccard of two texts.  A text with repeated shingles has a second sketch in which each counts
once, and so estimates the plain Jaccard; for other texts both are the same.  Bands of registers of both give candidates, candidates are
verified on the whole texts, and verified links are joined into classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm.components import connected

U64 = np.uint64
REGISTERS, BANDS, THRESHOLD, WIDTH = 256, 32, 0.8, 5
#: Pairs whose registers agree this much less than the threshold aren't verified: eight standard deviations.
SLACK = 0.2
#: Texts and bytes of text in a block of a bucket; two blocks meet in a task.
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20
#: Shingles for which two blocks are compared at once.
COLUMNS = 4096


def weighted(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, their counts, and per text the index of its first."""
    data, offsets = K.buffers(column)
    starts, ends, firsts = K.words(data, offsets, K.LETTERS)
    hashes, firsts = K.shingles(K.span_hashes(data, starts, ends), firsts, width)
    owner = K.owners(firsts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(owner[at], np.arange(len(firsts)))


def sketches(hashes: np.ndarray, counts: np.ndarray, firsts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """A row of registers for each text, with the shingle that each register keeps; 0 for a text without words."""
    n = len(firsts) - 1
    times, kept = np.full(n * registers, np.inf), np.zeros(n * registers, U64)
    live, owner, at, turn = hashes, K.owners(firsts), np.zeros(len(hashes)), 0
    rate = counts.astype(float)
    while len(live):
        turn += 1
        draw = K.mix(live + np.array([turn], U64) * K.GOLDEN)
        at = at - np.log(((draw >> U64(12)).astype(float) + 0.5) / 2.0**52) / rate
        cell = owner * registers + (K.mix(draw) % U64(registers)).astype(np.int64)
        if turn == 1 and n:  # most arrivals of the first turn are late; the latest register bounds them from then on
            np.minimum.at(times, cell, at)
            won = at == times[cell]
            kept[cell[won]] = live[won]
        else:
            before = times[cell]
            early = at < before
            np.minimum.at(times, cell[early], at[early])
            won = early & (at == times[cell])
            kept[cell[won]] = live[won]
        last = times.reshape(n, registers).max(axis=1)
        go = at < last[owner]
        live, owner, at, rate = live[go], owner[go], at[go], rate[go]
    return kept.reshape(n, registers)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key for each band of each sketch."""
    rows = sketch.reshape(len(sketch), bands, sketch.shape[1] // bands)
    total = np.zeros(rows.shape[:2], U64) + np.arange(1, bands + 1, dtype=U64) * K.GOLDEN
    for k in range(rows.shape[2]):
        total = K.mix(total + rows[:, :, k])
    return total


def similarity(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> tuple[float, float]:
    """The probability Jaccard and the plain Jaccard of two weighted sets, given as ascending ids and weights.

    J_P sums, over common elements e, 1 / sum over d of max(p_d / p_e, q_d / q_e).  With r = q / p, the
    inner sum is split at r_e: elements with larger r add q_d / q_e, the others p_d / p_e.
    """
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0.0
    union = len(x) + len(y) - len(both)
    a, b = p[i].astype(float), q[j].astype(float)
    r = b / a
    order = np.argsort(r, kind="stable")
    a, b = a[order], b[order]
    only_p, only_q = float(p.sum() - a.sum()), float(q.sum() - b.sum())
    below = only_p + np.cumsum(a)
    above = only_q + b.sum() - np.cumsum(b)
    return float((1.0 / (below / a + above / b)).sum()), len(both) / union


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batches, "text"):
        hashes, counts, firsts = weighted(part.column("text"))
        sketch = sketches(hashes, counts, firsts)
        keys = [*band_keys(sketch).view(np.int64)]
        marks = [row.tobytes() for row in (sketch & U64(255)).astype(np.uint8)]
        owner, sizes = K.owners(firsts), np.diff(firsts)
        again = np.flatnonzero(np.bincount(owner[counts > 1], minlength=len(sizes)))
        own = hashes[np.isin(owner, again)]
        plain = sketches(own, np.ones(len(own), np.int64), np.concatenate(([0], np.cumsum(sizes[again]))))
        for k, row, more in zip(again, (plain & U64(255)).astype(np.uint8), band_keys(plain).view(np.int64)):
            keys[k], marks[k] = np.union1d(keys[k], more), marks[k] + row.tobytes()
        marks, bands = pa.array(marks, pa.binary()), pa.array([x if n else [] for x, n in zip(keys, sizes)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("fp"), bands, marks], ["doc_id", "fp", "bands", "marks"])


def _both_marks(column: pa.Array) -> np.ndarray:
    """The marks of both sketches of each text; those of one are both."""
    data, offsets = K.buffers(column)
    first = np.asarray(offsets[:-1], np.int64)
    second = np.asarray(offsets[1:], np.int64) - REGISTERS
    return data[np.stack([first, second], 1)[:, :, None] + np.arange(REGISTERS)]


def _near(least: float):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_both_marks(batch.column(c)) for c in ("a_marks", "b_marks"))
                batch = batch.filter(pa.array((a == b).mean(axis=2).max(axis=1) >= least))
            yield batch.select(["a", "b"])

    return near


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, seen = None, None
    for part in K.slices(batches, "b_text"):
        hashes, counts, firsts = weighted(part.column("b_text"))
        leaders, sims, plain = part.column("a_text"), [], []
        for k in range(part.num_rows):
            if (text := leaders[k].as_py()) != last:
                last, seen = text, weighted(pa.array([text], pa.string()))
            s = slice(firsts[k], firsts[k + 1])
            jp, j = similarity(seen[0], seen[1], hashes[s], counts[s])
            sims.append(jp)
            plain.append(j)
        yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sims, pa.float64()), pa.array(plain, pa.float64())], ["a", "b", "similarity", "jaccard"])


def _of_members(base: DataFrame, one: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, text) and (fp, marks) of the nodes that share a bucket with others."""
    wanted = buckets.select("fp", "node").distinct()
    keyed = base.select("fp", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("node"))
    texts = keyed.join(wanted, ["fp", "node"], "left_semi").dropDuplicates(["fp", "node"]).select("fp", "text")
    marks = one.join(wanted, ["fp", "node"], "left_semi").select("fp", "marks")
    return K.kept(texts, "texts"), K.kept(marks, "marks")


def _verify(pairs: DataFrame, texts: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that reach the threshold, with similarity and jaccard."""
    near = pairs.join(marks.select(F.col("fp").alias("a"), F.col("marks").alias("a_marks")), "a").join(marks.select(F.col("fp").alias("b"), F.col("marks").alias("b_marks")), "b")
    near = near.mapInArrow(_near(threshold - SLACK), "a binary, b binary")
    sides = near.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("b_text")), "b")
    sides = sides.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("a_text")), "a")
    found = sides.select("a", "b", "a_text", "b_text").mapInArrow(_verified, "a binary, b binary, similarity double, jaccard double")
    return found.where(F.greatest("similarity", "jaccard") >= threshold)


def _apart(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, fp, label, left) of the buckets of three or more nodes that aren't all in one class; left: not in the head's class."""
    known = classes.select(F.col("node").alias("fp"), "label")
    named = buckets.where("n > 2").select("key", "fp", F.col("head.fp").alias("head_fp")).join(known, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = named.join(known.select(F.col("fp").alias("head_fp"), F.col("label").alias("head_label")), "head_fp", "left").withColumn("head_label", F.coalesce("head_label", "head_fp"))
    named = K.kept(named.drop("head_fp"), "named")
    open_keys = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return named.join(open_keys, "key", "left_semi").select("key", "fp", "label", (F.col("label") != F.col("head_label")).alias("left"))


def _cells(apart: DataFrame, texts: DataFrame, rows: int, size: int) -> DataFrame:
    """apart with texts, dealt into cells (key, i, j) of two blocks of a bucket; every two nodes of a bucket meet in one cell."""
    sized = apart.join(texts.select("fp", F.octet_length("text").alias("bytes")), "fp")
    blocks = sized.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum("bytes") / size), F.lit(1)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int")
    dealt = apart.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "label", "left").join(texts, "fp")


def _counted(ids: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, values: tuple[np.ndarray, ...], pairs: tuple[tuple[int, int], ...]) -> list[np.ndarray]:
    """For each pair (p, q) of value arrays, the sums over common ids of values p of each left text times values q of each text."""
    _, column, many = np.unique(ids, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(many > 1)
    place = np.full(len(many), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    order = np.argsort(column, kind="stable")
    edges = np.searchsorted(column[order], np.arange(0, len(shared) + COLUMNS, COLUMNS))
    out = [np.zeros((len(left), n), np.float32) for _ in pairs]
    for k, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
        o = order[s:e]
        dense = []
        for v in values:
            m = np.zeros((n, COLUMNS), np.float32)
            m[owner[o], column[o] - k * COLUMNS] = v[o]
            dense.append(m)
        for total, (p, q) in zip(out, pairs):
            total += dense[p][left] @ dense[q].T
    return out


def _spanning(near: np.ndarray, left: np.ndarray, labels: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs of `near` (left texts by all texts) that join the labelled classes as far as all of its pairs do, and the labels after that."""
    out: list[tuple[int, int]] = []
    while True:
        found = []
        for worst, seek in ((len(labels), np.argmin), (-1, np.argmax)):
            seen = np.where(near, labels[None, :], worst)
            at = seek(seen, axis=1)
            other = seen[np.arange(len(left)), at]
            go = np.flatnonzero((other != worst) & (other != labels[left]))
            found.extend(zip(left[go].tolist(), at[go].tolist()))
        if not found:
            return out, labels
        parent = np.arange(len(labels))

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for x, y in found:
            p, q = root(labels[x]), root(labels[y])
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
        labels = np.array([root(c) for c in range(len(parent))])[labels]


def _met(threshold: float):
    def met(table: pa.Table) -> pa.Table:
        """Links that join classes of a cell: of all pairs of a left text and another, compared whole."""
        n = table.num_rows
        left = np.flatnonzero(table.column("left").to_numpy())
        parts = [weighted(part.column("text")) for batch in table.select(["text"]).combine_chunks().to_batches() for part in K.slices(iter([batch]), "text")]
        hashes, counts = (np.concatenate([part[k] for part in parts]) for k in (0, 1))
        sizes = np.concatenate([np.diff(part[2]) for part in parts])
        firsts = np.concatenate(([0], np.cumsum(sizes)))
        owner, ones = K.owners(firsts), np.ones(len(hashes), np.float32)
        _, labels = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)
        (both,) = _counted(hashes, owner, n, left, (ones,), ((0, 0),))
        near = both / np.maximum(sizes[left][:, None] + sizes[None, :] - both.astype(float), 1) >= threshold
        near[np.arange(len(left)), left] = False
        pairs, labels = _spanning(near, left, labels)
        repeats = np.bincount(owner[counts > 1], minlength=n) > 0
        if repeats.any():
            # terms of the probability Jaccard whose counts agree have this bound, the others at most their share of either text
            weights = np.bincount(owner, counts, n)
            of_left, of_other = _counted(hashes, owner, n, left, (ones, counts.astype(np.float32)), ((1, 0), (0, 1)))
            (even,) = _counted(K.mix(hashes) + counts.astype(U64), owner, n, left, (ones, counts.astype(np.float32)), ((1, 0),))
            w, v = weights[left][:, None], weights[None, :]
            bound = even / np.maximum(w + v - np.minimum(of_left, of_other), 1) + np.minimum((of_left - even) / np.maximum(w, 1), (of_other - even) / np.maximum(v, 1))
            likely = (bound >= threshold - 1e-6) & (repeats[left][:, None] | repeats[None, :]) & (labels[left][:, None] != labels[None, :])
            for i, y in zip(*np.nonzero(likely)):
                x = left[i]
                if labels[x] != labels[y]:
                    a, b = slice(firsts[x], firsts[x + 1]), slice(firsts[y], firsts[y + 1])
                    if similarity(hashes[a], counts[a], hashes[b], counts[b])[0] >= threshold:
                        pairs.append((int(x), int(y)))
                        labels = np.where(labels == labels[y], labels[x], labels)
        fps, rows = table.column("fp").to_pylist(), []
        for x, y in pairs:
            a, b = slice(firsts[x], firsts[x + 1]), slice(firsts[y], firsts[y + 1])
            rows.append((min(fps[x], fps[y]), max(fps[x], fps[y]), *similarity(hashes[a], counts[a], hashes[b], counts[b])))
        cols = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.float64(), pa.float64()))], ["a", "b", "similarity", "jaccard"])

    return met


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links) of documents (doc_id, text).

    members: one row per input row: doc_id, class_id, the least doc_id of its class, and class_size in rows.
    links: verified pairs of different texts, a < b by least doc_id: a, b, similarity (probability Jaccard)
    and jaccard (of shingle sets); a pair is linked when either reaches the threshold.

    A null or empty text has no words: it belongs with exact copies of itself only, null counting as empty.
    Rows with equal texts are one node; repeated rows are kept, each with its class.  A null doc_id stays
    null and sorts first.  Other columns are ignored.

    In a bucket of a band, all nodes are first paired with the bucket's least node only; those go to verification whose
    registers' last bytes agree enough.  Where a bucket's nodes are not all in one class after that, those outside its
    head's class are held against all of the bucket, block by block inside tasks; only links that join classes leave a task.
    The classes are those of all pairs that share a bucket; of the links, enough to join each class are returned.
    """
    sketched, nodes, labelled, links = _classes(docs, threshold)
    members = sketched.select("doc_id", "fp").join(labelled, "fp").select("doc_id", "class_id", "class_size")
    named = nodes.select("fp", "least")
    links = links.join(named.select(F.col("fp").alias("a"), F.col("least").alias("a_id")), "a").join(named.select(F.col("fp").alias("b"), F.col("least").alias("b_id")), "b")
    return members, links.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity", "jaccard")


def _classes(docs: DataFrame, threshold: float, blocks: tuple[int, int] = (BLOCK_ROWS, BLOCK_BYTES)) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, fp), nodes (fp, least), classes (fp, label, class_id, class_size) and links of fingerprints."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("fp", F.unhex(F.md5("text")))
    sketched = K.kept(base.mapInArrow(_sketched, "doc_id long, fp binary, bands array<long>, marks binary"), "sketches")
    nodes = sketched.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = K.kept(nodes.withColumn("node", F.coalesce("least", F.lit(-(2**63)))), "nodes")
    one = sketched.select("fp", F.coalesce("doc_id", F.lit(-(2**63))).alias("node"), "bands", "marks").join(nodes.select("fp", "node"), ["fp", "node"]).dropDuplicates(["fp", "node"])
    banded = one.select(F.explode("bands").alias("key"), "fp", "node")
    heads = banded.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = K.kept(banded.join(heads, "key").select("key", "fp", "node", "n", "head"), "buckets")
    texts, marks = _of_members(base, one, buckets)

    pairs = buckets.where(F.col("head.fp") != F.col("fp")).select(F.col("head.fp").alias("a"), F.col("fp").alias("b")).distinct()
    links = K.kept(_verify(pairs, texts, marks, threshold), "links")
    classes = connected(links)
    apart = K.kept(_apart(buckets, classes), "apart")
    if not apart.isEmpty():
        found = _cells(apart, texts, *blocks).groupBy("key", "i", "j").applyInArrow(_met(threshold), "a binary, b binary, similarity double, jaccard double")
        links = K.kept(links.unionByName(found).dropDuplicates(["a", "b"]), "links")
        classes = connected(links)
    labelled = nodes.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = labelled.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    labelled = K.kept(labelled.join(ids, "label").select("fp", "label", "class_id", "class_size"), "classes")
    return sketched, nodes, labelled, links


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with one row left of each class: the one with the least doc_id, then the least text hash.

    Rows with a null doc_id are held against each other only: a class keeps one of them beside that with an id.
    Empty texts are no near-duplicates and all stay.  The columns of docs are kept as they are.
    """
    rows, _, labelled, _ = _classes(docs, threshold)
    best = rows.join(labelled, "fp").groupBy("label", F.isnull("doc_id")).agg(F.min(F.struct("doc_id", "fp")).alias("k"))
    best = best.select(F.col("k.doc_id").alias("__keep"), F.col("k.fp").alias("__text"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = text.rlike("[A-Za-z0-9\\x{80}-\\x{10FFFF}]")
    some = docs.where(words).withColumn("__id", F.col("doc_id").cast("long")).withColumn("__fp", F.unhex(F.md5(text)))
    some = some.join(best, F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__fp") == F.col("__text")), "left_semi")
    return some.dropDuplicates(["__id", "__fp"]).drop("__id", "__fp").unionByName(docs.where(~words))


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and class_size of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
