"""Substring dedup by compact windows.

Texts are sequences of shingles of five words.  Under a hash function, a compact window (l, k, r) says that every
subsequence that begins in [l, k] and ends in [k, r] has its minimum at k: the node of a Cartesian tree over
the hashes.  Only windows of at least 46 shingles (50 words) can hold a passage, and they are the top of the tree: their
minima are the minima of sliding windows of that length.  Windows with one minimum, of one function, group the subsequences that
share that part of a signature.  Each group is linked to its least text, first among the texts that a task has read, and then the least
ones of the tasks among each other; clipped to both sides, the windows are
intervals, and where intervals of enough functions meet, a passage is a candidate, verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import kernels as K

U64 = np.uint64
FUNCTIONS, ENOUGH = 4, 2
WORDS, WIDTH, THRESHOLD = 50, 5, 0.8
LEAST = WORDS - WIDTH + 1
FLUSH = 300_000
#: Two passages of the threshold share a stretch of 21 shingles or more word for word; each such stretch has one of the runs of SHORT shingles that
#: are least among NEXT neighbours.  A run's texts are held against one of them, by one of DRAWS orders of all texts, around SIDE shingles on both sides.
SHORT, NEXT, DRAWS, SIDE = 16, 6, 6, 60


def shingle_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.buffers(column)
    starts, ends, firsts = K.words(data, offsets, K.LETTERS)
    return K.shingles(K.span_hashes(data, starts, ends), firsts, WIDTH)


def compact_windows(hashes: np.ndarray, firsts: np.ndarray, function: int, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(minimum's hash, text, l, k, r) of all compact windows of at least `least` shingles, places within their text.

    Of equal hashes the first is the lesser.
    """
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < least:
        return np.zeros(0, U64), none, none, none, none
    bits = max(1, n.bit_length())
    values = K.mix(hashes + np.array([function + 1], U64) * K.GOLDEN)
    ranked = (values >> U64(bits) << U64(bits)) | np.arange(n, dtype=U64)
    pad = -n % least
    wide = np.concatenate([ranked, np.full(pad, ~U64(0))]).reshape(-1, least)
    ahead = np.minimum.accumulate(wide, axis=1).ravel()
    behind = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    sizes = np.diff(firsts)
    begins = K.ragged(firsts[:-1], np.maximum(sizes - least + 1, 0))
    tops = np.unique(np.minimum(behind[begins], ahead[begins + least - 1]) & U64((1 << bits) - 1)).astype(np.int64)
    owner = np.searchsorted(firsts, tops, "right") - 1
    # nearest lesser minima on both sides; what bounds a long window is the minimum of a longer one
    left, right = firsts[owner].copy(), firsts[owner + 1] - 1
    stack: list[int] = []
    rank, own, place = ranked[tops].tolist(), owner.tolist(), tops.tolist()
    for i in range(len(place)):
        while stack and (own[stack[-1]] != own[i] or rank[stack[-1]] > rank[i]):
            j = stack.pop()
            if own[j] == own[i]:
                right[j] = place[i] - 1
        if stack:
            left[i] = place[stack[-1]] + 1
        stack.append(i)
    base = firsts[owner]
    return values[tops], owner, left - base, tops - base, right - base


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def _expanded(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


CANDIDATE = "a long, b long, function int, key long, place int, low int, high int, start int, end int"
_INTS = ("function", "place", "low", "high", "start", "end")
#: Candidates in a row, where they travel with packed windows.
TOGETHER = 4096
PACKED = f"part int, keys binary, tids binary, places binary, found array<struct<{CANDIDATE.replace(' ', ': ').replace(',:', ',')}>>"


def _led(key: np.ndarray, tid: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, function: np.ndarray, whole: bool) -> tuple[np.ndarray, pa.StructArray]:
    """(the first window of each group, CANDIDATE rows of the others) of windows that reach left and right of a place.

    A candidate is a window (low, place, high) of b with the least text a of its group, and what both windows span; start is -1
    if that is too short for a passage, which is of use only if the group has a third window.  whole: there are no more of a group.
    """
    order = np.lexsort((at, tid, function, key))
    key, tid, at, left, right, function = (x[order] for x in (key, tid, at, left, right, function))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (function[1:] != function[:-1])
    group = np.cumsum(new) - 1
    lead = np.flatnonzero(new)[group]
    less, more = np.minimum(left, left[lead]), np.minimum(right, right[lead])
    good = less + more + 1 >= LEAST
    some = tid != tid[lead]
    if whole:
        some &= good | (np.bincount(group)[group] > 2)
    g = np.flatnonzero(some)
    ints = (function[g], at[g], at[g] - left[g], at[g] + right[g], np.where(good, at - less, -1)[g], at[g] + more[g])
    columns = dict(zip(_INTS, (pa.array(x.astype(np.int32)) for x in ints))) | {"a": pa.array(tid[lead[g]]), "b": pa.array(tid[g]), "key": pa.array(key[g].view(np.int64))}
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    return order[np.flatnonzero(new)], pa.StructArray.from_arrays([columns[n] for n in names], names)


def _windows(parts: int):
    """PACKED rows: the first window of each group of a flush, packed by part, and the candidates that the others of the flush are.

    So a key that a third of all texts hold is one window of each flush.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, seen = 0, set()

        def flush():
            key, tid, left, at, right, function = (np.concatenate(x) for x in zip(*held))
            first, led = _led(key, tid, at, at - left, right - at, function, whole=False)
            key, tid, left, at, right, function = (x[first] for x in (key, tid, left, at, right, function))
            part = (K.mix(key) % U64(parts)).astype(np.int64)
            order = np.lexsort((key, part))
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(edge)):
                o = order[edge[p] : edge[p + 1]]
                names, local = np.unique(tid[o], return_inverse=True)
                ints = np.stack([local, at[o], at[o] - left[o], right[o] - at[o], function[o]]).astype(np.uint32).ravel()
                rows.append((int(p), _squeezed(np.diff(key[o], prepend=U64(0))), names.tobytes(), _squeezed(ints)))
            cols = list(zip(*rows))
            # candidates are dealt to the parts in turn, from one that depends on the texts alone
            turns = -(-len(led) // TOGETHER)
            ends = np.minimum(np.arange(turns + 1) * TOGETHER, len(led))
            offsets = np.concatenate([np.zeros(len(rows), np.int64), ends])
            deal = (int(tid.min() % parts) + np.arange(turns)) % parts
            found = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), led)
            none = [None] * turns
            columns = [pa.array(np.concatenate([cols[0], deal]).astype(np.int32)), *(pa.array([*c, *none], pa.binary()) for c in cols[1:]), found]
            return pa.RecordBatch.from_arrays(columns, ["part", "keys", "tids", "places", "found"])

        for part in K.slices(batches, "text"):
            tids = part.column("tid").to_numpy()
            fresh = np.array([not (t in seen or seen.add(t)) for t in tids.tolist()], bool)
            part = part.filter(pa.array(fresh))
            hashes, firsts = shingle_hashes(part.column("text"))
            tids = part.column("tid").to_numpy()
            for f in range(FUNCTIONS):
                value, owner, left, at, right = compact_windows(hashes, firsts, f)
                held.append((value, tids[owner], left, at, right, np.full(len(value), f)))
                size += len(value)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
            if len(seen) > 1_000_000:  # only spares work
                seen.clear()
        if size:
            yield flush()

    return windows


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CANDIDATE rows of PACKED rows that come sorted by part: those of a flush, and those of the flushes' first windows."""

    def candidates(rows):
        keys, tids, ints = [], [], []
        for raw, names, places in rows:
            keys.append(np.cumsum(_expanded(raw, "u8"), dtype=U64))
            x = _expanded(places, "u4").reshape(5, -1).astype(np.int64)
            tids.append(np.frombuffer(names, np.int64)[x[0]])
            ints.append(x[1:])
        at, left, right, function = np.concatenate(ints, axis=1)
        return pa.RecordBatch.from_struct_array(_led(np.concatenate(keys), np.concatenate(tids), at, left, right, function, whole=True)[1])

    now, rows = None, []
    for batch in batches:
        packed = batch.filter(batch.column("keys").is_valid())
        if packed.num_rows < batch.num_rows:
            yield pa.RecordBatch.from_struct_array(batch.filter(batch.column("keys").is_null()).column("found").flatten())
        for r in packed.select(["part", "keys", "tids", "places"]).to_pylist():
            if r["part"] != now and rows:
                yield candidates(rows)
                rows = []
            now = r["part"]
            rows.append((r["keys"], r["tids"], r["places"]))
    if rows:
        yield candidates(rows)


def covered(functions: np.ndarray, starts: np.ndarray, ends: np.ndarray, enough: int = ENOUGH, least: int = LEAST) -> list[tuple[int, int]]:
    """The maximal ranges of at least `least` places that intervals of enough different functions cover."""
    size = int(ends.max()) + 1
    depth = np.zeros(size + 1, np.int64)
    for f in np.unique(functions):
        steps = np.zeros(size + 1, np.int64)
        np.add.at(steps, starts[functions == f], 1)
        np.add.at(steps, ends[functions == f] + 1, -1)
        depth += np.cumsum(steps) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (depth >= enough).astype(np.int8), [0]))))
    return [(int(s), int(e) - 1) for s, e in zip(edge[::2], edge[1::2]) if e - s >= least]


def _requested(enough: int):
    """(a, b, start, hashes): the shingles of b's candidate ranges."""

    def requested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text", 1 << 20):
            hashes, firsts = shingle_hashes(part.column("text"))
            rows = []
            for k, found in enumerate(part.column("found")):
                x = found.values
                a, f, s, e = (x.field(c).to_numpy() for c in ("a", "function", "start", "end"))
                own = hashes[firsts[k] : firsts[k + 1]]
                b = part.column("b")[k].as_py()
                order = np.argsort(a, kind="stable")
                for group in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
                    for start, end in covered(f[group], s[group].astype(np.int64), e[group].astype(np.int64), enough):
                        rows.append((int(a[group[0]]), b, start, (own[start : end + 1] >> U64(32)).astype("<u4").tobytes()))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["a", "b", "start", "hashes"])

    return requested


def least_runs(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the runs of SHORT shingles, per text the index of its first, whether each is the least of some NEXT neighbours)."""
    runs, begins = K.shingles(hashes, firsts, SHORT)
    least = np.zeros(len(runs), bool)
    if len(runs) >= NEXT:
        wide = np.lib.stride_tricks.sliding_window_view(runs, NEXT)
        least[np.arange(len(wide)) + wide.argmin(axis=1)] = True
    else:
        least[:] = True
    return runs, begins, least


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, b, start, end, draw, asks): hashes of the runs of the least passage's length that lie in a window and hold its minimum, with
    draw -1, and of the least short runs about the minimum, with their surroundings in the window, which ask if the window does."""
    for part in K.slices(batches, "text", 1 << 20):
        hashes, firsts = shingle_hashes(part.column("text"))
        b = part.column("b").to_numpy()
        spots = part.column("spots")
        x = spots.flatten()
        own = np.repeat(np.arange(part.num_rows), spots.value_lengths().to_numpy(zero_copy_only=False))
        place, low, high = (x.field(c).to_numpy().astype(np.int64) for c in ("place", "low", "high"))
        asks = x.field("asks").to_numpy(zero_copy_only=False)
        order = np.argsort(~asks, kind="stable")  # of windows with one run, one that asks comes first
        own, place, low, high, asks = (v[order] for v in (own, place, low, high, asks))
        runs, begins = K.shingles(hashes, firsts, LEAST)
        s = np.maximum(low, place - LEAST + 1)
        n = np.maximum(np.minimum(place, high - LEAST + 1) - s + 1, 0)
        at = np.unique(K.ragged(begins[own] + s, n))
        text = np.searchsorted(begins, at, "right") - 1
        start = at - begins[text]
        whole = (runs[at].view(np.int64), b[text], start, start + LEAST - 1, np.full(len(at), -1), np.ones(len(at), bool))
        runs, begins, least = least_runs(hashes, firsts)
        s = np.maximum(low, place - LEAST)
        n = np.maximum(np.minimum(place + LEAST, high) - SHORT + 1 - s + 1, 0)
        at, first = np.unique(K.ragged(begins[own] + s, n), return_index=True)
        spot = np.repeat(np.arange(len(own)), n)[first]
        at, spot = at[least[at]], spot[least[at]]
        start = at - begins[own[spot]]
        name = K.mix(runs[at] ^ K.GOLDEN)
        short = (name.view(np.int64), b[own[spot]], np.maximum(low[spot], start - SIDE), np.minimum(high[spot], start + SHORT - 1 + SIDE), (name % U64(DRAWS)).astype(np.int64), asks[spot])
        columns = [pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(whole, short), (np.int64, np.int64, np.int32, np.int32, np.int32, bool))]
        yield pa.RecordBatch.from_arrays(columns, ["run", "b", "start", "end", "draw", "asks"])


#: The share of matches on both sides at which two sets reach the threshold.
SHARE = 2 * THRESHOLD / (1 + THRESHOLD)


def segments(matched: np.ndarray, threshold: float = SHARE, least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges of at least `least` places, from runs of matches that are joined while matches stay the given share."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], matched.astype(np.int8), [0]))))
    out: list[list[int]] = []
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if out and out[-1][2] + e - s >= threshold * (e - out[-1][0]):
            out[-1][1], out[-1][2] = e, out[-1][2] + e - s
        else:
            out.append([s, e, e - s])
    return [(s, e) for s, e, _ in out if e - s >= least]


def _compared(x: np.ndarray, at: np.ndarray, own: np.ndarray, order: np.ndarray, s: int, e: int) -> tuple[int, int, int, int, float]:
    """(s, e, low, high, similarity) of the shingles x[s:e] and those of the other text from low to high."""
    places = np.sort(order[at[s:e][at[s:e] >= 0]])
    # some shingles also occur elsewhere: take the range of the passage's size that holds most of them
    last_in = np.searchsorted(places, places + (e - s) * 5 // 4, "right") - 1
    best = int(np.argmax(last_in - np.arange(len(places))))
    low, high = int(places[best]), int(places[last_in[best]])
    p, q = np.unique(x[s:e]), np.unique(own[low : high + 1])
    both = len(np.intersect1d(p, q, assume_unique=True))
    return s, e, low, high, both / (len(p) + len(q) - both)


RESULT = "a long, b long, a_start int, a_end int, b_start int, b_end int, similarity double"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, own = None, np.zeros(0, np.uint32)
    for batch in batches:
        rows = []
        for r, text in zip(batch.select(["a", "b", "start", "hashes"]).to_pylist(), batch.column("text")):
            if r["a"] != last:
                last = r["a"]
                own = (shingle_hashes(pa.array([text.as_py()], pa.string()))[0] >> U64(32)).astype(np.uint32)
                order = np.argsort(own, kind="stable")
                ranked = own[order]
            x = np.frombuffer(r["hashes"], "<u4")
            at = K.membership(x, ranked)
            for s, e in segments(at >= 0):
                found = _compared(x, at, own, order, s, e)
                if found[-1] < THRESHOLD:  # joined runs that fall short together may still do so alone
                    alone = [(s + i, s + j) for i, j in segments(at[s:e] >= 0, 1.0)]
                    found_all = [_compared(x, at, own, order, i, j) for i, j in alone]
                else:
                    found_all = [found]
                rows.extend((r["a"], r["b"], low, high + WIDTH, r["start"] + i, r["start"] + j - 1 + WIDTH, value) for i, j, low, high, value in found_all if value >= THRESHOLD)
        cols = list(zip(*rows)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["a", "b", "a_start", "a_end", "b_start", "b_end", "similarity"])


def _passages(found: DataFrame, texts: DataFrame, enough: int) -> DataFrame:
    """RESULT rows of candidate intervals (a, b, function, start, end), where those of enough functions meet."""
    lists = found.groupBy("b").agg(F.collect_list(F.struct("a", "function", "start", "end")).alias("found"))
    asked = lists.join(texts, F.col("b") == F.col("tid")).select("b", "found", "text").mapInArrow(_requested(enough), "a long, b long, start int, hashes binary")
    return asked.join(texts, F.col("a") == F.col("tid")).select("a", "b", "start", "hashes", "text").mapInArrow(_verified, RESULT)


def shared_passages(docs: DataFrame) -> DataFrame:
    """Passages of at least 50 words that documents (doc_id, text) share, as (doc_id, other_id, kind, start, end, other_start, other_end, similarity).

    Rows of kind "passage" link different texts, each by its least doc_id, to the least text of a group: the words
    [start, end) of doc_id and [other_start, other_end) of other_id have shingle sets of a Jaccard similarity of 0.8 or more.  Where windows of a group
    don't share a passage with its least text, their runs of 46 shingles around the minimum are grouped by themselves, so that texts which
    share a run word for word are linked whatever other texts hold its minima; and so are short runs about it, each led by another
    text, so that texts with a passage that is edited find each other among texts that quote parts of it.  Rows of kind "copy"
    link each further document of 50 words or more to the least doc_id with the same text, by 128 bits of hash.  Documents that share
    nothing have no row.  Null and empty texts share nothing, repeats within one text neither; repeated rows with
    one id are one document, and a null id counts as the least.  Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tid", F.xxhash64("text"))
    more = F.xxhash64(F.lit(1), "text").alias("more")
    node = F.coalesce("doc_id", F.lit(-(2**63)))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.select("tid", "text").mapInArrow(_windows(parts), PACKED)
    found = packed.repartition(parts // 2, "part").sortWithinPartitions("part").mapInArrow(_grouped, CANDIDATE)
    found = K.kept(found.distinct(), "candidates", "zstd")
    members = K.kept(rows.select("doc_id", "tid", more, (F.regexp_count("text", F.lit("[A-Za-z0-9\\x{80}-\\x{10FFFF}]+")) >= WORDS).alias("long")), "members")
    nodes = members.groupBy("tid").agg(F.min(node).alias("node"))
    wanted = found.select("a").unionByName(found.select(F.col("b").alias("a"))).distinct().join(nodes, F.col("a") == F.col("tid")).select("tid", "node")
    texts = rows.select("tid", node.alias("node"), "text").join(wanted, ["tid", "node"], "left_semi").dropDuplicates(["tid", "node"]).select("tid", "text")
    texts = K.kept(texts, "texts")
    good = K.kept(_passages(found.where("start >= 0"), texts, ENOUGH), "passages")
    # windows that no passage with their leader holds, of groups with two or more of them
    inside = good.select("a", "b", "b_start", "b_end")
    left = found.alias("f").join(inside.alias("g"), (F.col("f.a") == F.col("g.a")) & (F.col("f.b") == F.col("g.b")) & F.col("place").between(F.col("b_start"), F.col("b_end") - WIDTH), "left_anti")
    left = K.kept(left, "left", "zstd")
    several = left.groupBy("function", "key").agg(F.min("b").alias("low_b"), F.max("b").alias("high_b")).where("low_b <> high_b").select("function", "key")
    # where another leader's passage holds the minimum the text is linked already: there it may lead short runs, but needn't ask for a leader
    ranges = inside.groupBy("b").agg(F.collect_set(F.struct("b_start", "b_end")).alias("ranges"))
    spots = left.join(several, ["function", "key"], "left_semi").groupBy("b").agg(F.collect_set(F.struct("place", "low", "high")).alias("spots")).join(ranges, "b", "left")
    linked = lambda s: F.exists("ranges", lambda r: s["place"].between(r["b_start"], r["b_end"] - WIDTH))
    spots = spots.select("b", F.transform("spots", lambda s: F.struct(s["place"].alias("place"), s["low"].alias("low"), s["high"].alias("high"), (~F.coalesce(linked(s), F.lit(False))).alias("asks"))).alias("spots"))
    runs = K.kept(spots.join(texts, F.col("b") == F.col("tid")).select("b", "spots", "text").mapInArrow(_whole, "run long, b long, start int, end int, draw int, asks boolean"), "runs", "zstd")
    first = F.min(F.struct(F.when(F.col("draw") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("b", "draw")).alias("rank"), "b"))
    leads = runs.groupBy("run").agg(first.alias("first"), F.min("b").alias("low_b"), F.max("b").alias("high_b")).where("low_b < high_b").select("run", F.col("first.b").alias("a"))
    again = runs.where("asks").join(leads, "run").where("a <> b").select("a", "b", F.lit(0).alias("function"), "start", "end").distinct()
    good = K.kept(good.unionByName(_passages(again, texts, 1)).distinct(), "passages")
    ids = members.groupBy("tid").agg(F.min("doc_id").alias("id"))
    passages = good.join(ids.select(F.col("tid").alias("b"), F.col("id").alias("doc_id")), "b").join(ids.select(F.col("tid").alias("a"), F.col("id").alias("other_id")), "a")
    passages = passages.select("doc_id", "other_id", F.lit("passage").alias("kind"), F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.col("a_start").alias("other_start"), F.col("a_end").alias("other_end"), "similarity")
    none = F.lit(None).cast("int")
    same = members.groupBy("tid", "more").agg(F.min("doc_id").alias("id"))
    copies = members.where("long").join(same, ["tid", "more"]).where(~F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", F.col("id").alias("other_id"), F.lit("copy").alias("kind"), none.alias("start"), none.alias("end"), none.alias("other_start"), none.alias("other_end"), F.lit(1.0).alias("similarity"))
    return passages.unionByName(copies.distinct())


def op1_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that documents share."""
    return shared_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
