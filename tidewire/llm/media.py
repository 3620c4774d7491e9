"""Media columns: content-defined chunks, deduplicated by joins, and reconstruction from ordered chunk lists.

A payload is cut where a rolling gear hash of its last 32 bytes has zeros in its low bits.  Chunks are named by the first
16 bytes of their SHA-256; of equal chunks one media object keeps the bytes, and the others only list the name.  A media
object is stored as a row: the ordered chunk list (each chunk's size, name and whether it is owned) and the 8-bit samples of the chunks that
it owns, which Parquet compresses.  Its bytes and hash are those of that list and those samples, as they are read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import kernels as K

LEAST, MOST, CUT_BITS = 1024, 16384, 11
FRAME = 576
GEAR = (K.mix((np.arange(256, dtype=np.uint64) + np.uint64(77)) * K.GOLDEN) >> np.uint64(32)).astype(np.uint32)
#: Bytes of the dictionary of what is shuffled, and of the texts that it is taken from.
DICTIONARY, DICTIONARY_TEXTS = 1 << 19, (256, 4096)
NAME_BYTES, LEVEL, PACK_LEVEL, STORE_LEVEL = 16, 9, 12, 12
#: Bytes of a page of stored samples: small rows next to each other compress as one.
PAGE = 1 << 23
CHUNK = "struct<pos:int,digest:binary,size:int,owned:boolean,shared:boolean>"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR[byte j before] << j for j below 32, modulo 2**32, by doubling the window."""
    h, width = GEAR[data], 1
    while width < 32:
        before = np.zeros_like(h)
        before[width:] = h[:-width] if len(h) > width else 0
        if len(h) <= width:
            break
        h = h + (before << np.uint32(width))
        width *= 2
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """The ends of each payload's chunks, from its own bytes only: a chunk is longer than the window."""
    marks = np.flatnonzero((gear_hashes(data) >> np.uint32(32 - CUT_BITS)) == 0) + 1
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends, at = [], a
        own = marks[np.searchsorted(marks, a) : np.searchsorted(marks, b)]
        while b - at > LEAST:
            k = int(np.searchsorted(own, at + LEAST))
            at = min(at + MOST, b, int(own[k]) if k < len(own) else b)
            ends.append(at)
        if not ends or ends[-1] < b:
            ends.append(b)
        out.append(ends)
    return out


def payloads(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, unpadded sizes): texts as UTF-8 with bytes 255 up to a positive multiple of the frame."""
    data, offsets = K.buffers(column)
    sizes = np.diff(offsets)
    full = np.maximum(1, -(-sizes // FRAME)) * FRAME
    out_offsets = np.concatenate(([0], np.cumsum(full)))
    out = np.full(int(out_offsets[-1]), 255, np.uint8)
    out[K.ragged(out_offsets[:-1], sizes)] = data
    return out, out_offsets, sizes


def name_of(data) -> bytes:
    """The name of a chunk or payload."""
    return hashlib.sha256(data).digest()[:NAME_BYTES]


def dictionary(texts: DataFrame) -> bytes:
    """At most DICTIONARY bytes of texts, which help to compress small payloads; only the size of the shuffle depends on them."""
    short = texts.where(F.octet_length("text").between(*DICTIONARY_TEXTS)).select("text").limit(DICTIONARY // DICTIONARY_TEXTS[0])
    return (b"\xff" * FRAME + b"".join(r.text.encode() for r in short.toLocalIterator()))[:DICTIONARY]


def packers(content: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """A compressor and a decompressor with this dictionary."""
    shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(level=PACK_LEVEL)
    return zstandard.ZstdCompressor(level=PACK_LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in K.slices(batches, "text"):
        data, offsets, sizes = payloads(part.column("text"))
        raw, rows, names = memoryview(data), [], []
        for a, ends in zip(offsets[:-1].tolist(), cuts(data, offsets)):
            rows.append([name_of(raw[s:e]) for s, e in zip([a, *ends[:-1]], ends)])
            names.append(name_of(raw[a : ends[-1]]))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(rows, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media_id", "digests"])


def _packed(content):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, _ = packers(content.value)
        for part in K.slices(batches, "text"):
            data, offsets, _ = payloads(part.column("text"))
            raw = memoryview(data)
            spans = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in spans], pa.binary()), pa.array([squeeze.compress(s) for s in spans], pa.binary())], ["media_id", "blob"])

    return packed


def _owned(content):
    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts each payload again and keeps the chunks that it owns: all but those that its flags lend from others."""
        _, expand = packers(content.value)
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("digest", pa.binary()), ("size", pa.int32()), ("owned", pa.bool_()), ("shared", pa.bool_())]))
        for part in K.slices(batches, "blob", 1 << 18):
            raws = [expand.decompress(blob.as_py()) for blob in part.column("blob")]
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
            lists, blobs = [], []
            for raw, a, ends, flags in zip(raws, offsets.tolist(), cuts(np.frombuffer(b"".join(raws), np.uint8), offsets), part.column("flags").to_pylist()):
                owned = {f["pos"]: f["owned"] for f in flags or []}
                spans = [(s - a, e - a) for s, e in zip([a, *ends[:-1]], ends)]
                lists.append([{"pos": k, "digest": name_of(raw[s:e]), "size": e - s, "owned": owned.get(k, True), "shared": k in owned} for k, (s, e) in enumerate(spans)])
                blobs.append(b"".join(raw[s:e] for k, (s, e) in enumerate(spans) if owned.get(k, True)))
            yield pa.RecordBatch.from_arrays([part.column("media_id"), pa.array(lists, kind), pa.array(blobs, pa.binary())], ["media_id", "chunks", "blob"])

    return owned


def _lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, bytes) of owned chunks that others list."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    for part in K.slices(batches, "blob"):
        names, parts = [], []
        for blob, chunks in zip(part.column("blob"), part.column("chunks").to_pylist()):
            own = [c for c in chunks if c["owned"]]
            if any(c["shared"] for c in own):
                raw, at = blob.as_py(), 0
                for c in own:
                    if c["shared"]:
                        names.append(c["digest"])
                        parts.append(squeeze.compress(raw[at : at + c["size"]]))
                    at += c["size"]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(parts, pa.binary())], ["digest", "part"])


def stored_form(chunks: list[dict], own: bytes) -> bytes:
    """What a media row holds, as bytes: "CDC1", the number of chunks, each chunk's size, ownership and name, and the owned samples."""
    return b"CDC1" + struct.pack("<I", len(chunks)) + b"".join(struct.pack("<IB", c["size"], c["owned"]) + c["digest"] for c in chunks) + own


def features(payload: bytes, n_chunks: int) -> str:
    """Chunks, sum, sum of squares and a histogram of 16 bins of the samples."""
    x = np.frombuffer(payload, np.uint8)
    wide = x.astype(np.int64)
    return f"{n_chunks}|{int(wide.sum())}|{int((wide * wide).sum())}|" + ",".join(map(str, np.bincount(x >> 4, minlength=16).tolist()))


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for part in K.slices(batches, "blob"):
        rows = []
        for name, blob, chunks, lent in zip(part.column("media_id"), part.column("blob"), part.column("chunks").to_pylist(), part.column("lent").to_pylist()):
            own, at, other, out = blob.as_py(), 0, {x["pos"]: x["part"] for x in lent or []}, []
            for c in chunks:
                if c["owned"]:
                    bit = own[at : at + c["size"]]
                    at += c["size"]
                else:
                    bit = expand.decompress(other[c["pos"]])
                digest = hashlib.sha256(bit).digest()
                if digest[:NAME_BYTES] != c["digest"]:
                    raise ValueError("a chunk isn't the one that its list names")
                out.append(bit)
            payload, media = b"".join(out), stored_form(chunks, own)
            rows.append((name.as_py(), len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).digest(), features(payload, len(out))))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 7, (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], ["media_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def write(docs: DataFrame, path: str) -> None:
    """Stores the texts of documents (doc_id, text) under path: rows, a row of (doc_id, n_bytes, media_id) each, and media.

    Null texts count as empty.  Equal texts are one media object.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    content = rows.sparkSession.sparkContext.broadcast(dictionary(rows))
    listed = K.kept(rows.mapInArrow(_listed, "doc_id long, n_bytes long, media_id binary, digests array<binary>"), "lists", "zstd")
    listed.select("doc_id", "n_bytes", "media_id").write.option("compression", "zstd").parquet(f"{path}/rows")
    # a chunk at one place only needs no row: its payload owns it; rows of equal payloads are the same place
    each, place = listed.select("media_id", F.posexplode("digests").alias("pos", "digest")), F.struct("media_id", "pos")
    several = each.groupBy("digest").agg(F.min(place).alias("owner"), F.max(place).alias("last")).where("owner <> last").select("digest", "owner")
    flags = each.join(several, "digest").select("media_id", F.struct("pos", (place == F.col("owner")).alias("owned")).alias("flag")).groupBy("media_id").agg(F.collect_set("flag").alias("flags"))
    blobs = rows.select("text").mapInArrow(_packed(content), "media_id binary, blob binary").dropDuplicates(["media_id"])
    whole = blobs.join(flags, "media_id", "left").select("media_id", "flags", "blob")
    whole.mapInArrow(_owned(content), f"media_id binary, chunks array<{CHUNK}>, blob binary").write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", STORE_LEVEL).option("parquet.page.size", PAGE).parquet(f"{path}/media")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per stored row: doc_id, n_bytes and what is computed from the verified samples read back.

    A chunk whose bytes don't have its digest raises.  Objects that own all their chunks are rebuilt where they are
    read; only the others, and the chunks they borrow, are shuffled.
    """
    media = spark.read.schema(f"media_id binary, chunks array<{CHUNK}>, blob binary").parquet(f"{path}/media")
    whole = F.forall("chunks", lambda c: c["owned"])
    lent = media.where(F.exists("chunks", lambda c: c["owned"] & c["shared"])).mapInArrow(_lent, "digest binary, part binary")
    asked = media.where(~whole).select("media_id", F.explode(F.filter("chunks", lambda c: ~c["owned"])).alias("c")).select("media_id", "c.pos", "c.digest")
    got = asked.join(lent, "digest").groupBy("media_id").agg(F.collect_list(F.struct("pos", "part")).alias("lent"))
    some = media.where(~whole).join(got, "media_id")
    none = media.where(whole).withColumn("lent", F.lit(None).cast("array<struct<pos:int,part:binary>>"))
    every = none.unionByName(some).select("media_id", "chunks", "blob", "lent")
    rebuilt = every.mapInArrow(_rebuilt, "media_id binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string")
    rows = spark.read.schema("doc_id long, n_bytes long, media_id binary").parquet(f"{path}/rows")
    both = rows.join(rebuilt, "media_id").drop("media_id")
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})


def op5_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every document's payload as chunks and returns what is read back."""
    path = K.shared_path(spark, "media")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path)
