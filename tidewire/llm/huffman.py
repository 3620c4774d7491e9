"""Token ids in canonical length-limited Huffman files.

Words are encoded with a tokenizer of the tokenizers library; the counts of all ids give one code of
at most LIMIT bits (package-merge), kept as code lengths alone.  Each document is a row of the file: a header, a bit-offset
checkpoint for every block of BLOCK ids, and the bits.  Blocks decode independently of each other, all together, by
one table that gives an id and its length for the next LIMIT bits.

Files are Parquet files of such rows, in ascending doc_id order within and across files, and a table of code lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import kernels as K

U64 = np.uint64
LIMIT, BLOCK, END_ID = 20, 512, 2
#: Words whose ids a worker keeps before it begins anew; only speed depends on it.
KEPT_WORDS = 1_500_000
MAGIC = 0x46485754  # "TWHF"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits for the symbols that occur; 0 for the others.

    Package-merge: limit times, adjacent pairs of the cheapest packages are joined and merged with the symbols again; a
    symbol's length is the number of chosen packages that hold it.
    """
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("too many symbols for the limit")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    n = len(leaves)
    # level by level, only how many of the first k items are leaves is needed to trace lengths back
    weights, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        joined = np.concatenate([leaves, pairs])
        rank = np.argsort(joined, kind="stable")
        weights = joined[rank]
        is_leaf.append(rank < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(is_leaf):
        some = int(flags[:take].sum())
        lengths[:some] += 1
        take = 2 * (take - some)
    out[order] = lengths
    return out


class Code:
    """The canonical code of code lengths: shorter codes first, then smaller ids."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT) -> None:
        self.lengths, self.limit = lengths.astype(np.int64), limit
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[self.lengths[order] > 0]
        sizes = np.int64(1) << (limit - self.lengths[order])
        starts = np.cumsum(sizes) - sizes  # left-aligned codes
        self.codes = np.zeros(len(lengths), U64)
        self.codes[order] = (starts >> (limit - self.lengths[order])).astype(U64)
        self.symbol = np.zeros(1 << limit, np.int32)
        self.symbol[: int(sizes.sum())] = np.repeat(order, sizes)
        self.bits = np.ones(1 << limit, np.int8)
        self.bits[: int(sizes.sum())] = np.repeat(self.lengths[order], sizes)

    def encode(self, ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all documents, each from a fresh 64-bit word; bit offsets of ids within their document; byte offsets)."""
        n = self.lengths[ids]
        ends = np.concatenate(([0], np.cumsum(n)))
        doc_bits = ends[firsts[1:]] - ends[firsts[:-1]]
        words = (doc_bits + 63) // 64
        word_firsts = np.concatenate(([0], np.cumsum(words)))
        counts = np.diff(firsts)
        local = ends[:-1] - np.repeat(ends[firsts[:-1]], counts)
        at = local + np.repeat(64 * word_firsts[:-1], counts)
        word, shift = at >> 6, at & 63
        out = np.zeros(int(word_firsts[-1]) + 1, U64)
        code, room = self.codes[ids], 64 - shift - n
        head = np.where(room >= 0, code << np.maximum(room, 0).astype(U64), code >> np.maximum(-room, 0).astype(U64))
        if len(ids):
            new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[new]] = np.add.reduceat(head, new)  # bits don't overlap, so that sums are unions
            over = np.flatnonzero(room < 0)
            out[word[over] + 1] += code[over] << (64 + room[over]).astype(U64)
        return out[:-1].astype(">u8").view(np.uint8), local, 8 * word_firsts

    def decode(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of blocks that begin at bit starts, counts of them each, joined; all blocks move together."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        out_firsts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        order = np.argsort(-counts, kind="stable")
        at, to, left = starts[order].copy(), out_firsts[order], counts[order]
        mask = (1 << self.limit) - 1
        for k in range(int(counts.max(initial=0))):
            live = int(np.searchsorted(-left, -k, "left"))  # blocks with more than k ids
            p = at[:live]
            byte = p >> 3
            window = (padded[byte].astype(np.int64) << 24) | (padded[byte + 1].astype(np.int64) << 16) | (padded[byte + 2].astype(np.int64) << 8) | padded[byte + 3]
            key = (window >> (32 - self.limit - (p & 7))) & mask
            out[to[:live] + k] = self.symbol[key]
            at[:live] = p + self.bits[key]
        return out


class WordEncoder:
    """The library's ids of whole texts, by way of the ids of their words, each of which is encoded once.

    The tokenizer drops white space and never joins characters across it, so that a text's ids are those of the
    pieces between ASCII white space.  A piece of ASCII characters and letters U+00C0 to U+00FF is also cut between a letter and
    ASCII punctuation, where the pattern always ends a match; not in pieces with an apostrophe or with < and |, which
    contractions and special tokens contain.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keys, self.firsts, self.counts, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and per text the index of its first id."""
        data, offsets = K.buffers(column)
        starts, ends, firsts = pieces(data, offsets)
        keys = K.span_hashes(data, starts, ends)
        fresh, where, which = np.unique(keys, return_index=True, return_inverse=True)
        at = K.membership(fresh, self.keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.keys) > KEPT_WORDS:
                self.keys, self.firsts, self.counts, self.ids = self.keys[:0], self.firsts[:0], self.counts[:0], self.ids[:0]
                new = np.arange(len(fresh))
            raw = data.tobytes()
            got = [e.ids for e in self.tokenizer.encode_batch_fast([raw[s:e].decode() for s, e in zip(starts[where[new]].tolist(), ends[where[new]].tolist())], add_special_tokens=False)]
            counts = np.fromiter(map(len, got), np.int64, len(got))
            begun = len(self.ids)
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.int32, int(counts.sum()))])
            every = np.concatenate([self.keys, fresh[new]])
            order = np.argsort(every, kind="stable")
            self.keys = every[order]
            self.firsts = np.concatenate([self.firsts, begun + np.cumsum(counts) - counts])[order]
            self.counts = np.concatenate([self.counts, counts])[order]
            at = K.membership(fresh, self.keys)
        at = at[which]
        counts = self.counts[at]
        ids = self.ids[K.ragged(self.firsts[at], counts)]
        return ids, np.concatenate(([0], np.cumsum(counts)))[firsts]


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:127] = True
_PUNCTUATION &= ~_LETTER & ~_DIGIT
_PUNCTUATION[39] = False


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces that are encoded on their own, and per text the index of its first."""
    starts, ends, firsts = K.words(data, offsets, K.VISIBLE)
    if not len(starts):
        return starts, ends, firsts
    lead = np.concatenate(([False], data[:-1] == 0xC3)) & (data >= 0x80) & (data != 0x97) & (data != 0xB7)
    letter, mark = _LETTER[data] | lead, _PUNCTUATION[data]
    next_letter = _LETTER[data] | ((data == 0xC3) & np.concatenate((lead[1:], [False])))
    cut = np.zeros(len(data), bool)
    cut[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & next_letter[1:])
    odd = ((data >= 0x80) & ~lead & ~((data == 0xC3) & np.concatenate((lead[1:], [False])))) | (data == 39) | (data == 60) | (data == 0)
    total = np.concatenate(([0], np.cumsum(odd)))
    plain = total[ends] == total[starts]
    inner = np.flatnonzero(cut)
    own = np.searchsorted(starts, inner, "right") - 1
    inner = inner[(own >= 0) & (inner > starts[own]) & (inner < ends[own]) & plain[own]]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = edge[inner] = True
    all_starts = np.flatnonzero(edge)
    edge[starts] = False
    edge[ends] = True
    all_ends = np.flatnonzero(edge[1:]) + 1
    return all_starts, all_ends, np.searchsorted(all_starts, offsets)


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _tokenized(path: str, end_id: int):
    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for part in K.slices(batches, "text"):
            ids, firsts = encoder.encode(part.column("text"))
            ids = np.insert(ids, firsts[1:], end_id)
            firsts = firsts + np.arange(len(firsts))
            raw = ids.astype("<u4" if len(ids) and ids.max() > 65535 else "<u2")
            width = raw.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((firsts * width).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed, pa.array(np.full(part.num_rows, width, np.int8))], ["doc_id", "ids", "width"])

    return tokenized


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of rows (ids, width), joined, and per row the index of its first."""
    data, offsets = K.buffers(part.column("ids"))
    width = part.column("width").to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.diff(offsets) // width
    if len(width) and (width == width[0]).all():
        flat = data.view("<u2" if width[0] == 2 else "<u4")
    else:
        flat = np.concatenate([np.zeros(0, np.int64), *(data[a:b].view("<u2" if w == 2 else "<u4") for a, b, w in zip(offsets[:-1], offsets[1:], width))])
    return flat.astype(np.int64), np.concatenate(([0], np.cumsum(counts)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for part in K.slices(batches, "ids"):
        got = np.bincount(_ids(part)[0])
        if len(got) > len(total):
            got[: len(total)] += total
            total = got
        else:
            total[: len(got)] += got
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


def _packed(shared):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for part in K.slices(batches, "ids"):
            ids, firsts = _ids(part)
            data, local, byte_firsts = code.encode(ids, firsts)
            counts = np.diff(firsts)
            rows = []
            for k in range(part.num_rows):
                marks = local[firsts[k] : firsts[k + 1] : BLOCK].astype("<u4")
                rows.append(np.array([MAGIC, counts[k], len(marks)], "<u4").tobytes() + marks.tobytes() + data[byte_firsts[k] : byte_firsts[k + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "n_tokens", "bits"])

    return packed


def unpacked(code: Code, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of file rows, joined, and per row the index of its first."""
    data, offsets = K.buffers(rows)
    starts, sizes, counts = [], [], []
    for at in offsets[:-1].tolist():
        magic, n, blocks = data[at : at + 12].view("<u4").tolist() if at % 4 == 0 else np.frombuffer(data[at : at + 12].tobytes(), "<u4").tolist()
        if magic != MAGIC:
            raise ValueError("not a row of token ids")
        marks = np.frombuffer(data[at + 12 : at + 12 + 4 * blocks].tobytes(), "<u4").astype(np.int64)
        starts.append(8 * (at + 12 + 4 * blocks) + marks)
        size = np.full(blocks, BLOCK, np.int64)
        if blocks:
            size[-1] = n - BLOCK * (blocks - 1)
        sizes.append(size)
        counts.append(n)
    none = np.zeros(0, np.int64)
    ids = code.decode(data, np.concatenate([none, *starts]), np.concatenate([none, *sizes]))
    return ids, np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def _read(shared):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "bits", 1 << 20):
            ids, firsts = unpacked(shared.value, part.column("bits"))
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), part.column("place"), pa.array(np.diff(firsts), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    return read


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Writes the ids of documents (doc_id, text), end_id after each, to path/ids and the code to path/lengths.

    Null texts count as empty.  Rows go in ascending doc_id order, nulls first, ties by the MD5 of their bits; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = K.kept(rows.mapInArrow(_tokenized(tokenizer_path, end_id), "doc_id long, ids binary, width byte"), "tokens")
    counts = tokens.mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(1 + max([r.id for r in counts], default=0), np.int64)
    for r in counts:
        total[r.id] = r.n
    lengths = code_lengths(total)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.parquet(f"{path}/lengths")
    bits = tokens.mapInArrow(_packed(spark.sparkContext.broadcast(Code(lengths))), "doc_id long, n_tokens long, bits binary")
    place = F.md5("bits")  # many rows of one id, or of none, are many files
    bits = bits.repartitionByRange("doc_id", place).sortWithinPartitions("doc_id", place)
    bits.withColumn("part", F.spark_partition_id()).write.option("compression", "none").parquet(f"{path}/ids")


def read_code(spark: SparkSession, path: str) -> Code:
    """The code of written files; its table has at most an entry for each id of the tokenizer."""
    rows = spark.read.parquet(f"{path}/lengths").collect()
    lengths = np.zeros(1 + max([r.id for r in rows], default=0), np.int64)
    for r in rows:
        lengths[r.id] = r.length
    return Code(lengths)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of written files: doc_id, start, n_tokens and ids_crc32, all from the decoded ids.

    start counts the ids of all documents before it: within a file by a window, and across files by the files' totals, one
    row each.
    """
    from pyspark.sql import Window

    files = spark.read.parquet(f"{path}/ids").select("doc_id", "bits", "part")
    # a file's documents may be read by several tasks; doc_id and the digest order them as they were written
    place = files.select("doc_id", "bits", "part", F.md5("bits").alias("place"))
    got = K.kept(place.mapInArrow(_read(spark.sparkContext.broadcast(read_code(spark, path))), "doc_id long, part int, place string, n_tokens long, ids_crc32 long"), "decoded")
    totals = got.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("part").orderBy("doc_id", "place").rowsBetween(Window.unboundedPreceding, -1)
    inside = got.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    return inside.join(before, "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op6_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every document and returns what the files hold."""
    import public_tokenizers

    path = K.shared_path(spark, "token-ids")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return digests(spark, path)
