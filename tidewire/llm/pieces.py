"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of scored pieces.

Spaces are written as the marker U+2581, with one marker before each text that is not empty.  The best
segmentation maximises the sum of the pieces' log scores.  A character that no piece begins with alone gets
the unknown score and is written as its bytes.  Decoding joins the pieces, turns markers into spaces and drops
the first one.

No piece of a vocabulary split at white space has a marker after another character, and none has a line
feed, so each text falls into units (a run of markers with what follows up to the next marker or line feed)
that are segmented on their own.  Each worker keeps the segmentations of units that it has met.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import kernels as K

U64 = np.uint64
MARKER, SPACE, NEWLINE = "▁", 32, 10
UNKNOWN_PENALTY = 10.0
#: Units of more bytes are segmented one by one.
WIDE = 48
#: Segmentations that a worker keeps before it begins anew; only speed depends on it.
KEPT_UNITS = 400_000
#: Bytes of the units that move through the lattice together; each takes some twenty bytes of memory.
LATTICE = 1 << 18


class DoubleArray:
    """A trie of byte strings in two arrays: the child of state s by byte b is t = base[s] + b if check[t] == s."""

    def __init__(self, keys: list[bytes]) -> None:
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for value, key in enumerate(keys):
            at = 0
            for b in key:
                if (to := tree[at].get(b)) is None:
                    tree.append({})
                    to = tree[at][b] = len(tree) - 1
                at = to
            ends[at] = value
        size = 3 * len(tree) + 1024
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        taken, place, first, last = np.zeros(size, bool), [0] * len(tree), 1, 1
        taken[0] = True
        for node in sorted(range(len(tree)), key=lambda k: -len(tree[k])):  # those with many children are hardest to place
            if children := tree[node]:
                codes = np.array(sorted(children))
                if len(codes) == 1:  # any free place
                    first += int((~taken[first:]).argmax()) if first >= 256 else 256 - first + int((~taken[256:]).argmax())
                    last = first
                at, span = max(1, last - int(codes[0])), 256
                while True:
                    fits = ~taken[codes[:, None] + np.arange(at, at + span)].any(axis=0)
                    if fits.any():
                        break
                    at += span
                    if at + 2 * span > size:
                        taken, base, check, value = (np.concatenate([x, np.full(size, f, x.dtype)]) for x, f in ((taken, False), (base, 0), (check, -1), (value, -1)))
                        size *= 2
                at += int(fits.argmax())
                last = max(1, at - 256)
                taken[at + codes] = True
                children[-1] = at
                for c in codes.tolist():
                    place[children[c]] = at + c
        for node, children in enumerate(tree):
            if children:
                base[place[node]] = at = children.pop(-1)
                for c, to in children.items():
                    check[at + c] = place[node]
                    value[at + c] = ends.get(to, -1)
        # a state has the root's place only by mistake: no child lies at 0, and check there stays -1
        self.base, self.check, self.value = base, check, value


@dataclass
class Vocabulary:
    """Pieces with scores: the trie of ordinary pieces, ids of byte pieces and the bytes that each id decodes to."""

    trie: DoubleArray
    ids: np.ndarray
    scores: np.ndarray
    unknown: float
    byte_ids: np.ndarray
    data: np.ndarray
    firsts: np.ndarray
    lengths: np.ndarray


def vocabulary(pieces: list[tuple[int, bytes, float]], byte_ids: list[int]) -> Vocabulary:
    """A vocabulary of (id, UTF-8 bytes, log score) and the ids of the 256 byte pieces."""
    keys = [p.replace(MARKER.encode(), b" ") for _, p, _ in pieces]
    if any(b" " in k.lstrip(b" ") or b"\n" in k for k in keys):
        raise ValueError("pieces across white space aren't supported")
    size = max([*(i for i, _, _ in pieces), *byte_ids]) + 1
    raw = [b""] * size
    for (i, _, _), k in zip(pieces, keys):
        raw[i] = k
    for b, i in enumerate(byte_ids):
        raw[i] = bytes([b])
    lengths = np.array([len(x) for x in raw])
    scores = np.array([s for _, _, s in pieces])
    return Vocabulary(DoubleArray(keys), np.array([i for i, _, _ in pieces]), scores, float(scores.min()) - UNKNOWN_PENALTY, np.array(byte_ids), np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths) - lengths, lengths)


def load(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file.

    A unigram file's scores are log probabilities and are used as they are.  A BPE file's scores are whole
    numbers that only order its merges; the log probabilities of Zipf's law over that order stand in:
    minus the logarithm of the rank, from 1, less that of the harmonic sum.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = np.array([model.get_score(i) for i in plain])
    if len(scores) and np.array_equal(scores, np.round(scores)):
        ranks = np.empty(len(scores))
        ranks[np.argsort(-scores, kind="stable")] = np.arange(1, len(scores) + 1)
        scores = -np.log(ranks) - np.log((1 / ranks).sum())
    return vocabulary([(i, model.id_to_piece(i).encode(), float(s)) for i, s in zip(plain, scores)], [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def public_vocabulary(name: str = "piece_bpe_32k.model") -> Vocabulary:
    import public_tokenizers

    return load(public_tokenizers.path(name))


def _char_lengths(data: np.ndarray) -> np.ndarray:
    """Bytes of the character that begins at each byte (1 for the others)."""
    return (1 + (data >= 0xC0) + (data >= 0xE0) + (data >= 0xF0)).astype(np.uint8)


def segmented(v: Vocabulary, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best ids of each unit data[start : start + length], joined, and their number for each unit.

    All units move through the lattice together: at each byte position, those that have a path to it walk
    down the trie and offer their score to the positions where a piece ends.  Of equal scores the
    longer last piece stays.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = int(lengths.max())
    cells = np.full((n, wide + 1), 0, np.uint8)
    at = K.ragged(np.arange(n) * (wide + 1), lengths)
    cells.ravel()[at] = data[K.ragged(starts, lengths)]
    chars = _char_lengths(cells)
    best = np.full((n, wide + 1), -np.inf)
    best[:, 0] = 0
    back, piece = np.zeros((n, wide + 1), np.int32), np.full((n, wide + 1), -1, np.int32)
    base, check, value = v.trie.base, v.trie.check, v.trie.value
    for s in range(wide):
        rows = np.flatnonzero((lengths > s) & (best[:, s] > -np.inf))
        if not len(rows):
            continue
        single = np.zeros(n, bool)
        live, state, d = rows, np.zeros(len(rows), np.int64), 0
        while len(live):
            to = base[state] + cells[live, s + d]
            ok = check[to] == state
            live, state = live[ok], to[ok]
            d += 1
            found = value[state]
            ended = found >= 0
            r, f = live[ended], found[ended]
            offer = best[r, s] + v.scores[f]
            single[r[chars[r, s] == d]] = True
            win = offer > best[r, s + d]
            r, f = r[win], f[win]
            best[r, s + d], back[r, s + d], piece[r, s + d] = offer[win], s, f
            more = lengths[live] > s + d
            live, state = live[more], state[more]
        r = rows[~single[rows]]
        to = np.minimum(s + chars[r, s], lengths[r])
        offer = best[r, s] + v.unknown
        win = offer > best[r, to]
        r, to = r[win], to[win]
        best[r, to], back[r, to], piece[r, to] = offer[win], s, -1
    # back from the ends; an unknown character gives its bytes
    marks = np.full((n, wide), -1, np.int32)
    live, at = np.arange(n), lengths.copy()
    while len(live):
        b, p = back[live, at], piece[live, at]
        known = p >= 0
        marks[live[known], b[known]] = v.ids[p[known]]
        lost, lb, la = live[~known], b[~known], at[~known]
        for d in range(4):
            inside = lb + d < la
            marks[lost[inside], lb[inside] + d] = v.byte_ids[cells[lost[inside], lb[inside] + d]]
        live, at = live[b > 0], b[b > 0]
    taken = marks >= 0
    return marks[taken], taken.sum(axis=1)


class Encoder:
    """Encodes slices of texts, and keeps the segmentations of units."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.keys, self.firsts, self.counts, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        ids, counts = [self.ids], [self.counts]
        order = np.argsort(lengths, kind="stable")
        keys, starts, lengths = keys[order], starts[order], lengths[order]
        at = 0
        while at < len(keys):
            if lengths[at] <= WIDE:
                wide = min(WIDE, max(8, 2 * int(lengths[at])))
                to = min(at + max(1, LATTICE // wide), int(np.searchsorted(lengths, wide, "right")))
                x, c = segmented(self.v, data, starts[at:to], lengths[at:to])
            else:
                to = at + 1
                x = alone(self.v, data[starts[at] : starts[at] + lengths[at]])
                c = np.array([len(x)])
            ids.append(x.astype(np.int32))
            counts.append(c)
            at = to
        if len(self.keys) > KEPT_UNITS:
            self.keys, ids, counts = self.keys[:0], ids[1:], counts[1:]
            self.firsts = self.firsts[:0]
        counts = np.concatenate(counts) if len(self.keys) == 0 else np.concatenate([np.zeros(0, np.int64), *counts[1:]])
        begun = len(ids[0]) if len(self.keys) else 0
        self.ids = np.concatenate(ids)
        all_keys = np.concatenate([self.keys, keys])
        all_firsts = np.concatenate([self.firsts, begun + np.cumsum(counts) - counts])
        all_counts = np.concatenate([self.counts, counts]) if len(self.keys) else counts
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.firsts, self.counts = all_keys[order], all_firsts[order], all_counts[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and per text the index of its first id."""
        data, offsets = marked(column)
        starts, lengths, unit_firsts = units(data, offsets)
        keys = K.span_hashes(data, starts, starts + lengths, K.BYTE_VALUES)
        fresh, where, which = np.unique(keys, return_index=True, return_inverse=True)
        at = K.membership(fresh, self.keys)
        new = at < 0
        if new.any():
            self._learn(data, fresh[new], starts[where[new]], lengths[where[new]])
            at = K.membership(fresh, self.keys)
            if (gone := at < 0).any():  # forgotten at the same time
                self._learn(data, fresh[gone], starts[where[gone]], lengths[where[gone]])
                at = K.membership(fresh, self.keys)
        at = at[which]
        counts = self.counts[at]
        ids = self.ids[K.ragged(self.firsts[at], counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))[unit_firsts]
        out, out_offsets = decoded(self.v, ids, ends)
        if len(out) != len(data) or not np.array_equal(out, data):  # two units with one hash: such texts are encoded without the table
            parts = []
            for k in range(len(offsets) - 1):
                own = data[offsets[k] : offsets[k + 1]]
                same = np.array_equal(out[out_offsets[k] : out_offsets[k + 1]], own)
                parts.append(ids[ends[k] : ends[k + 1]] if same else one_by_one(self.v, own).astype(np.int32))
            ids, ends = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, ends


def marked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts with U+2581 as a space and, unless they are empty, one more space in front."""
    if _has_marker(column):
        column = pa.array([t and t.replace(MARKER, " ") for t in column.to_pylist()], column.type)
    data, offsets = K.buffers(column)
    some = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][some], SPACE)
    return data, offsets + np.concatenate(([0], np.cumsum(some)))


def _has_marker(column: pa.Array) -> bool:
    import pyarrow.compute as pc

    return bool(pc.any(pc.match_substring(column, MARKER)).as_py())


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the units, and per text the index of its first."""
    n = len(data)
    begin = np.zeros(n, bool)
    if n:
        space, feed = data == SPACE, data == NEWLINE
        begin[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
        begin[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(begin)
    return starts, np.diff(np.append(starts, n)), np.searchsorted(starts, offsets)


def alone(v: Vocabulary, data: np.ndarray) -> np.ndarray:
    """The best ids of one unit of any length, one character after another."""
    raw, n = data.tobytes(), len(data)
    best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    base, check, value, scores = v.trie.base, v.trie.check, v.trie.value, v.scores
    widths = _char_lengths(data).tolist()
    for s in range(n):
        if best[s] == -np.inf:
            continue
        state, single, to = 0, False, s
        while to < n:
            nxt = int(base[state]) + raw[to]
            if check[nxt] != state:
                break
            state, to = nxt, to + 1
            if (f := int(value[state])) >= 0:
                single |= to - s == widths[s]
                if (offer := best[s] + scores[f]) > best[to]:
                    best[to], back[to], piece[to] = offer, s, f
        if not single:
            to = min(n, s + widths[s])
            if (offer := best[s] + v.unknown) > best[to]:
                best[to], back[to], piece[to] = offer, s, -1
    out: list[int] = []
    at = n
    while at:
        b = back[at]
        out.extend([int(v.ids[piece[at]])] if piece[at] >= 0 else [int(v.byte_ids[x]) for x in reversed(raw[b:at])])
        at = b
    return np.array(out[::-1], np.int64)


def one_by_one(v: Vocabulary, data: np.ndarray) -> np.ndarray:
    """The ids of one marked text, unit by unit."""
    starts, lengths, _ = units(data, np.array([0, len(data)]))
    return np.concatenate([np.zeros(0, np.int64), *(alone(v, data[s : s + n]) for s, n in zip(starts, lengths))])


def decoded(v: Vocabulary, ids: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each with the space in front, and their offsets."""
    lengths = v.lengths[ids]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return v.data[K.ragged(v.firsts[ids], lengths)], ends[firsts]


def texts(v: Vocabulary, ids: np.ndarray, firsts: np.ndarray) -> list[str]:
    """The texts of ids; bytes that are no UTF-8 become U+FFFD."""
    data, offsets = decoded(v, ids, firsts)
    return [data[a:b].tobytes()[1:].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """This worker's encoder for a broadcast vocabulary."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def _encoded(shared):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for part in K.slices(batches, "text"):
            ids, firsts = encoder.encode(part.column("text"))
            lists = pa.ListArray.from_arrays(firsts.astype(np.int32), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return encode


def _round_trip(shared):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        v = encoder.v
        low = np.zeros(len(v.lengths), bool)
        low[v.byte_ids] = True
        for part in K.slices(batches, "text"):
            ids, firsts = encoder.encode(part.column("text"))
            data, offsets = decoded(v, ids, firsts)
            given, ends = K.buffers(part.column("text"))
            fallback = np.concatenate(([0], np.cumsum(low[ids])))[firsts]
            raw, flat = ids.astype("<u4"), data.tobytes()
            crc, sha, same = [], [], []
            for k in range(part.num_rows):
                text = flat[offsets[k] : offsets[k + 1]][1:]
                crc.append(zlib.crc32(raw[firsts[k] : firsts[k + 1]]))
                sha.append(hashlib.sha256(text).hexdigest())
                same.append(text == given[ends[k] : ends[k + 1]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(firsts), pa.int64()), pa.array(np.diff(fallback), pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)],
                ["doc_id", "n_tokens", "n_bytes", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return check


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id and ids (an array of int) of each row; a null or empty text has no ids.

    One row for each input row, in any order; other columns are ignored.
    """
    rows = _rows(docs)
    return rows.mapInArrow(_encoded(docs.sparkSession.sparkContext.broadcast(v)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def with_ids(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """docs with the column ids (replaced if it exists); a null or empty text has no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    @F.arrow_udf("array<int>")
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared)
        for column in columns:
            parts = []
            for part in K.slices([pa.RecordBatch.from_arrays([column], ["text"])], "text"):
                got, firsts = encoder.encode(part.column("text"))
                parts.append(pa.ListArray.from_arrays(firsts.astype(np.int32), pa.array(got.astype(np.int32))))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn("ids", ids(F.col("text").cast("string")))


def decode(tokens: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give null, no ids the empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(v)

    @F.arrow_udf("string")
    def joined(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in columns:
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out = texts(shared.value, flat, np.concatenate(([0], np.cumsum(counts))).astype(np.int64))
            yield pa.array([t if ok else None for t, ok in zip(out, ids.is_valid().to_pylist())], pa.string())

    return tokens.select("doc_id", joined("ids").alias("text"))


def round_trips(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Per row: doc_id, n_tokens, n_bytes (ids of byte pieces), ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), decoded_sha256 and round_trip (the decoded text is the given one).

    Only a text that holds the marker itself doesn't come back: its markers become spaces.
    """
    rows = _rows(docs)
    shared = docs.sparkSession.sparkContext.broadcast(v)
    return rows.mapInArrow(_round_trip(shared), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_bytes long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def op10_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoding of every document and its round trip."""
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary())
