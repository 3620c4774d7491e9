"""NumPy kernels over Arrow string buffers that the operators of this package share.

They run inside tasks on slices of a few megabytes, so that a worker's memory does not depend on the
number of rows in an Arrow batch.  All hashes are fixed functions of the bytes: the same text gives the
same values in every task, session and machine.
"""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20
GOLDEN = U64(0x9E3779B97F4A7C15)

_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_STEP = U64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def folded() -> np.ndarray:
    """A table from byte to byte that lower-cases A-Z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


FOLD = folded()
#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: Bytes of the words `[^\x20\x09-\x0D]+`.
VISIBLE = np.ones(256, bool)
VISIBLE[32] = VISIBLE[9:14] = False

BYTE_VALUES = mix((np.arange(256, dtype=U64) + U64(1)) * GOLDEN) | U64(1)
FOLDED_VALUES = BYTE_VALUES[FOLD]

_powers: dict[str, np.ndarray] = {}


def _grown(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if n <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty.  offsets[0] is 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def release() -> None:
    """Gives freed memory back to the system, so that a reused worker doesn't hold the peak of an earlier task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in slices of at most limit bytes of text, or of one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < len(lengths):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        release()


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of bytes in `inside`, and per text the index of its first run.

    Runs do not cross texts.  The last array has one entry more than there are texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    member = inside[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, member[:-1]
    after[-1], after[:-1] = False, member[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(member & ~before)
    return starts, np.flatnonzero(member & ~after) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED_VALUES) -> np.ndarray:
    """64-bit hashes of data[start:end] for each span, from one prefix sum of a polynomial in the position."""
    n = len(data)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(values[data] * _grown("up", _BASE, n), dtype=U64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _grown("down", _BASE_INVERSE, n + 1)[starts] + (ends - starts).astype(U64) * GOLDEN)


def owners(firsts: np.ndarray) -> np.ndarray:
    """The index of the text that each entry belongs to, from each text's first entry."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `width` words, and per text the index of its first shingle.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    counts = np.diff(firsts)
    out_counts = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out_firsts = np.concatenate(([0], np.cumsum(out_counts)))
    at = np.arange(out_firsts[-1]) - np.repeat(out_firsts[:-1], out_counts) + np.repeat(firsts[:-1], out_counts)
    left = np.repeat(np.minimum(counts, width), out_counts)
    total = np.zeros(len(at), U64)
    for k in range(width):
        inside = left > k
        part = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else total
        total = total * _WORD_STEP + np.where(inside, part, U64(0x1234567))
    return mix(total), out_firsts


def ragged(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices first, first + 1, ... of each range in turn."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(firsts - (ends - lengths), lengths)


def membership(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def shared_path(spark, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    Where spark.checkpoint.dir is unset, as in tests, it is a local one, which only a session on one machine can use.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(os.environ.get("TMPDIR", "/tmp"), "tidewire-checkpoints")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(frame, name: str, codec: str = "snappy"):
    """The frame, written to the shared folder and read again: a cut of the lineage that outlives executors."""
    spark = frame.sparkSession
    path = shared_path(spark, name)
    frame.write.option("compression", codec).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
