"""Sharding by histogram sort: splitters from exact counts, then one exchange.

Rows have keys of 16 bytes: half a hash of the text, so that equal texts lie side by side, then a hash of doc_id and of the
row's place in the input, so that no key holds many rows.  A round counts, for a few candidate boundaries in each splitter's bracket, the exact
bytes and rows below them, and finds the rows next to them; the brackets shrink to these until each splitter is within the tolerance of its target.  The driver
sees counts of candidates only.  Rows are exchanged once, to ranges that are parts of shards, and sorted there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidewire.llm import kernels as K

SHARDS = 24
#: What a row weighs besides its text.
OVERHEAD = 8
#: How far a splitter may be off its target, in parts of a shard's share.
TOLERANCE = 0.001
#: Candidate boundaries in each bracket and round.
PROBES = 15
KEY = 16
END = 1 << (8 * KEY)
#: The bits of a key that the text decides.
GROUP = END.bit_length() - 1 - 64


@dataclass(frozen=True)
class Mark:
    """A boundary and what lies below it."""

    key: int
    size: int
    rows: int


def keyed(docs: DataFrame) -> DataFrame:
    """docs with size, the UTF-8 bytes of the text (null: none) and the overhead, and the key; both are new columns in front of them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = F.monotonically_increasing_id().cast("string")  # tells rows apart that are equal otherwise
    owner = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.unhex(F.concat(F.substring(F.md5(text.cast("binary")), 1, 16), F.substring(F.md5(owner), 1, 10), F.substring(F.md5(place), 1, 6)))
    return docs.select((F.octet_length(text) + OVERHEAD).cast("long").alias("size"), key.alias("key"), *[F.col(f"`{c}`") for c in docs.columns])


def _fixed(column: pa.Array) -> np.ndarray:
    """Keys as NumPy strings, which compare as bytes do: all have the same length."""
    return K.buffers(column)[0].view(f"S{KEY}")


def _packed(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(KEY, "big") for k in keys), f"S{KEY}")


_BIN = "at int, size long, rows long, first binary, last binary"


def _counted(shared):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _packed(shared.value)
        n = len(probes) + 1
        sizes, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first, last = np.full(n, b"\xff" * KEY, f"S{KEY}"), np.zeros(n, f"S{KEY}")
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _fixed(batch.column("key"))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            edge = np.concatenate(([0], np.searchsorted(keys, probes, "left"), [len(keys)]))
            below = np.concatenate(([0], np.cumsum(batch.column("size").to_numpy(zero_copy_only=False)[order])))
            sizes += np.diff(below[edge])
            rows += np.diff(edge)
            some = np.flatnonzero(np.diff(edge))
            low, high = keys[edge[some]], keys[edge[some + 1] - 1]
            first[some] = np.where(low < first[some], low, first[some])
            last[some] = np.where(high > last[some], high, last[some])
        used = np.flatnonzero(rows)
        keys = [pa.Array.from_buffers(pa.binary(KEY), len(used), [None, pa.py_buffer(x[used].tobytes())]).cast(pa.binary()) for x in (first, last)]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sizes[used]), pa.array(rows[used]), *keys], ["at", "size", "rows", "first", "last"])

    return counted


def histogram(rows: DataFrame, probes: list[int]) -> list[tuple[Mark, Mark]]:
    """The bins between these ascending keys, each as a mark at its first row and one behind its last, with the exact bytes and rows below them.

    Empty bins are left out, so that marks are always next to rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(probes)
    bins = rows.select("size", "key").mapInArrow(_counted(shared), _BIN).groupBy("at")
    got = bins.agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last")).collect()
    shared.destroy()
    out, size, count = [], 0, 0
    for r in sorted(got, key=lambda r: r["at"]):
        low = Mark(int.from_bytes(r["first"], "big"), size, count)
        size, count = size + r["size"], count + r["rows"]
        out.append((low, Mark(int.from_bytes(r["last"], "big") + 1, size, count)))
    return out


def candidates(low: Mark, high: Mark) -> list[int]:
    """Keys between two boundaries, evenly spaced; starts of texts as long as there are such between them."""
    step = 1 << GROUP
    first, last = (low.key >> GROUP) + 1, (high.key - 1) >> GROUP
    if first > last:  # all in one text
        first, last, step = low.key + 1, high.key - 1, 1
    n = min(PROBES, last - first + 1)
    return [(first + (last - first) * k // max(1, n - 1) if n > 1 else (first + last) // 2) * step for k in range(n)]


def splitters(rows: DataFrame, shards: int, many: int, tolerance: float) -> list[Mark]:
    """Boundaries that cut rows (size, key) into many pieces of each shard, all of near equal bytes: each is within tolerance, in parts of a shard's share, of its target.

    Where one row is larger than that, the boundary is on that side of the row that is nearer to the target.  No rows have boundaries behind all keys.
    """
    pieces = shards * many
    whole = histogram(rows, [])
    if not whole:
        return [Mark(END, 0, 0)] * (pieces - 1)
    total = whole[0][1].size
    targets = [total * k / pieces for k in range(1, pieces)]
    brackets = [whole[0]] * len(targets)

    def near(k: int) -> Mark:
        return min(brackets[k], key=lambda m: abs(m.size - targets[k]))

    def open_(k: int) -> bool:
        a, b = brackets[k]
        return abs(near(k).size - targets[k]) > tolerance * total / shards and b.rows - a.rows > 1 and b.key - a.key > 1

    while unsure := [k for k in range(len(targets)) if open_(k)]:
        shares = Counter(brackets[k] for k in unsure)
        # brackets' own ends too, so that every bin lies inside of one; the first candidate parts its first text or row from the rest
        bins = histogram(rows, sorted({p for (a, b), n in shares.items() for p in (a.key, *_wide(a, b, n), b.key) if p < END}))
        ends = [b.size for _, b in bins]
        for k in unsure:
            # the bin that the target falls into, or the place between two
            at = min(int(np.searchsorted(ends, targets[k], "left")), len(bins) - 1)
            brackets[k] = bins[at]
    return [near(k) for k in range(len(targets))]


def _wide(low: Mark, high: Mark, targets: int) -> list[int]:
    """Candidates of a bracket that several targets share: as many for each."""
    found = candidates(low, high)
    if targets == 1 or len(found) < PROBES:
        return found
    first, last, n = found[0] >> GROUP, found[-1] >> GROUP, targets * PROBES
    return found if last - first < n else [(first + (last - first) * k // (n - 1)) << GROUP for k in range(n)]


def _placed(shared):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _packed(shared.value)
        for batch in batches:
            at = np.searchsorted(cuts, _fixed(batch.column("key")), "right") if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "piece"])

    return placed


def _numbered(shared, many: int):
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key: their places in their shards, from what lies below their pieces."""
        below, piece, seen = shared.value, -1, 0
        for batch in batches:
            pieces = batch.column("piece").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.arange(batch.num_rows)
            begins = np.maximum.accumulate(np.where(np.diff(pieces, prepend=piece) != 0, at, -1)) if batch.num_rows else at
            inside = np.where(begins < 0, at + seen, at - begins)
            if batch.num_rows:
                piece, seen = int(pieces[-1]), int(inside[-1]) + 1
            slots = inside + np.asarray(below, np.int64)[pieces]
            kept = [c for c in batch.schema.names if c not in ("key", "piece")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(pieces // many, pa.int32()), pa.array(slots)], [*kept, "shard", "slot"])

    return numbered


def exchanged(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (size, key, others) without the key, with shard and slot: the rounds of counting, then the one exchange.

    The rows are written first, so that what is counted is what is exchanged.  They are split further into ranges of a shard,
    about as many as the session's shuffle partitions in all, so that a task sorts a part of a shard.
    """
    spark = rows.sparkSession
    rows = K.kept(rows, "keyed")
    many = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    marks = splitters(rows, shards, many, tolerance)
    starts = [0, *(m.rows for m in marks)]
    below = [n - starts[k // many * many] for k, n in enumerate(starts)]
    context = spark.sparkContext
    placed = rows.mapInArrow(_placed(context.broadcast([m.key for m in marks if m.key < END])), StructType([*rows.schema.fields, StructField("piece", IntegerType())]))
    dealt = placed.repartitionById(shards * many, F.col("piece")).sortWithinPartitions("piece", "key")
    fields = [*(f for f in rows.schema.fields if f.name != "key"), StructField("shard", IntegerType()), StructField("slot", LongType())]
    return dealt.mapInArrow(_numbered(context.broadcast(below), many), StructType(fields))


def sharded(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """docs (doc_id, text, ...) with size, shard and slot.

    Bytes are near equal: a shard is off its share by at most twice the tolerance (of a share), or by the size of a row where rows are larger than that.
    Equal texts are in one shard unless the shard's boundary can't be near enough to its target outside of them.  slot
    counts a shard's rows from 0 without gaps, in the order of their keys.  Null and empty texts weigh the overhead; repeated rows are rows of
    their own; an empty table gives an empty one, and fewer rows than shards leave shards empty.  Columns of docs named like a
    result, key or piece are replaced, all others are kept.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("size", "key", "piece", "shard", "slot")]
    got = exchanged(keyed(docs.select(*own)).select("size", "key", F.struct(*own).alias("row")), shards, tolerance)
    return got.select("row.*", "size", "shard", "slot")


def text_crc32(text: Column) -> Column:
    """The unsigned CRC-32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def digests(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """What the query returns for documents (doc_id, text): checksums are exchanged instead of texts."""
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "size", "key", text_crc32(F.col("text")).alias("text_crc32"))
    got = exchanged(rows, shards, tolerance)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of documents under the law of near equal bytes."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
