"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the word sequences of all normalised benchmark items.  Training words are streamed
through it; the state gives, at each word, the longest run of words ending there that occurs in some item.
A window is ten consecutive item words, or a whole item of fewer words.  Words inside an occurrence of a
window are hit; hit spans are cut out, and documents that are mostly benchmark text are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import kernels as K

U64 = np.uint64
WINDOW = 10
#: Item words in one automaton (a longer item has its own): some 100 MB.  A larger benchmark is cut into several, of which the
#: driver and each task hold one at a time.
MAX_WORDS = 200_000
SPANS = "array<struct<start: int, end: int>>"


class SuffixAutomaton:
    """The generalised suffix automaton of items, each an array of word hashes.

    States are numbered; `step` maps (state, word) to a state, `link` and `length` are the suffix links and
    the longest lengths.  A window's items are kept at the state of its length: found by following links.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW) -> None:
        self.window = window
        self.words = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, U64)
        self.names = [name for name, _ in items]
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [K.membership(w, self.words).tolist() for _, w in items]
        for word_ids in coded:
            last = 0
            for w in word_ids:
                last = self._extended(last, w)
        self.bigrams = np.unique(np.concatenate([self.pairs(np.array(c)) for c in coded if len(c) > 1] or [np.zeros(0, np.int64)]))
        self.shortest = min([window, *(len(c) for c in coded)])
        self.window_items: list[set[int]] = [set() for _ in self.link]
        self.whole: list[dict[int, set[int]]] = [{} for _ in self.link]
        for k, word_ids in enumerate(coded):
            state = 0
            for w in word_ids:
                state = self.step[state][w]
                if (at := self.holder(state, window)) is not None:
                    self.window_items[at].add(k)
            if len(word_ids) < window:
                self.whole[self.holder(state, len(word_ids))].setdefault(len(word_ids), set()).add(k)
        # for each state, the short items that end wherever it ends: those of its own and of its links
        self.short: list[list[tuple[int, set[int]]]] = [[] for _ in self.link]
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[state] = self.short[self.link[state]] + [(n, s) for n, s in self.whole[state].items()]

    def pairs(self, word_ids: np.ndarray) -> np.ndarray:
        return word_ids[:-1] * len(self.words) + word_ids[1:]

    def holder(self, state: int, size: int) -> int | None:
        """The state of the suffix of `size` words of a state's words."""
        if self.length[state] < size:
            return None
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, at: int, via: int, word: int) -> int:
        twin = self._state(self.length[at] + 1, dict(self.step[via]), self.link[via])
        self.link[via] = twin
        while at >= 0 and self.step[at].get(word) == via:
            self.step[at][word] = twin
            at = self.link[at]
        return twin

    def _extended(self, last: int, word: int) -> int:
        if (via := self.step[last].get(word)) is not None:
            return via if self.length[via] == self.length[last] + 1 else self._split(last, via, word)
        new, at = self._state(self.length[last] + 1, {}, -1), last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        elif self.length[via := self.step[at][word]] == self.length[at] + 1:
            self.link[new] = via
        else:
            self.link[new] = self._split(at, via, word)
        return new

    def matched(self, word_ids: list[int]) -> tuple[list[int], set[int]]:
        """For each word the length of the longest window occurrence ending there, and the items found."""
        state, size, out, found = 0, 0, [], set()
        for w in word_ids:
            while state and w not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.step[state]:
                state, size = self.step[state][w], size + 1
            longest = 0
            for n, whole in self.short[state]:
                if n <= size:
                    longest = max(longest, n)
                    found |= whole
            if size >= self.window:
                longest = self.window
                found |= self.window_items[self._at(state)]
            out.append(longest)
        return out, found

    def _at(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state


def automata(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata of benchmark rows (item_id, text), of about max_words words each, one after another.

    Rows without words are left out; a null item_id is left out.  The driver streams the items.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").orderBy("item_id", "text")
    items, size = [], 0
    for row in rows.toLocalIterator():
        data, offsets = K.buffers(pa.array([row.text], pa.string()))
        starts, ends, _ = K.words(data, offsets, K.LETTERS)
        if not len(starts):
            continue
        if items and size + len(starts) > max_words:
            yield SuffixAutomaton(items, window)
            items, size = [], 0
        items.append((row.item_id, K.span_hashes(data, starts, ends)))
        size += len(starts)
    if items:
        yield SuffixAutomaton(items, window)


def _scan(column: pa.Array, machine: SuffixAutomaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """(word starts, ends, firsts, hit flags, items per text).

    Only runs of words whose every adjacent pair occurs in some item go through the automaton: no window
    can lie elsewhere.
    """
    data, offsets = K.buffers(column)
    starts, ends, firsts = K.words(data, offsets, K.LETTERS)
    hashes = K.span_hashes(data, starts, ends)
    hit = np.zeros(len(hashes), bool)
    found: list[set[str]] = [set() for _ in range(len(column))]
    owner = K.owners(firsts)
    ids = K.membership(hashes, machine.words)
    known = ids >= 0
    joined = np.zeros(len(ids), bool)  # this word and the one before are a pair of some item
    if len(ids) > 1:
        near = np.flatnonzero(known[1:] & known[:-1] & (owner[1:] == owner[:-1])) + 1
        joined[near[K.membership(ids[near - 1] * len(machine.words) + ids[near], machine.bigrams) >= 0]] = True
    begins = np.flatnonzero(known & ~joined)
    runs = np.append(np.flatnonzero(~joined), len(ids))
    stops = runs[np.searchsorted(runs, begins, "right")]
    long = stops - begins >= machine.shortest
    for b, e in zip(begins[long].tolist(), stops[long].tolist()):
        lengths, items = machine.matched(ids[b:e].tolist())
        if items:
            found[owner[b]].update(machine.names[k] for k in items)
            for k, n in enumerate(lengths):
                if n:
                    hit[b + k - n + 1 : b + k + 1] = True
    return starts, ends, firsts, hit, found


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _hits(shared):
    """(digest, spans, items) of the texts that have hits: word ranges and item ids."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text"):
            _, _, firsts, hit, found = _scan(part.column("text"), shared.value)
            some = [k for k, x in enumerate(found) if x]
            spans = [[{"start": a, "end": b} for a, b in _ranges(hit[firsts[k] : firsts[k + 1]])] for k in some]
            kinds = (pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("digest").take(pa.array(some, pa.int64())), pa.array(spans, kinds[0]), pa.array([sorted(found[k]) for k in some], kinds[1])], ["digest", "spans", "items"])

    return hits


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """(digest, spans, items) of the different texts that hold windows, by the MD5 of the text: spans are word ranges [start, end), which may
    overlap where several automata found them; items are sorted ids.

    Each automaton is broadcast, used and destroyed before the next one is built.
    """
    spark = docs.sparkSession
    rows, out = docs.select(F.md5(_text()).alias("digest"), _text().alias("text")), None
    for machine in automata(benchmark, window, max_words):
        shared = spark.sparkContext.broadcast(machine)
        some = K.kept(rows.mapInArrow(_hits(shared), f"digest string, spans {SPANS}, items array<string>"), "hits")
        shared.destroy()
        out = some if out is None else out.unionByName(some)
    if out is None:
        return rows.where("false").select("digest", F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    merged = out.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return merged


def _covered(spans: Column) -> Column:
    """Words in sorted ranges that may overlap."""
    first = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), (acc["n"] + F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, first, step, lambda acc: acc["n"])


def _n_words() -> Column:
    return F.regexp_count(_text(), F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.

    Null texts have no words.  One row per input row, repeated rows and null ids included; other columns
    are ignored.  Item ids that tie count once.  Without items nothing is hit.
    """
    found = hits(docs, benchmark, window, max_words)
    rows = docs.select("doc_id", F.md5(_text()).alias("digest"), _n_words().alias("n_words")).join(found, "digest", "left")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _cut(min_words: int):
    @F.arrow_udf("string")
    def cut(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """Texts without their word ranges of min_words or more."""
        for texts, spans in columns:
            out = []
            for text, found in zip(texts.to_pylist(), spans.to_pylist()):
                data, offsets = K.buffers(pa.array([text], pa.string()))
                starts, ends, _ = K.words(data, offsets, K.LETTERS)
                flags = np.zeros(len(starts), bool)
                for s in found:
                    flags[s["start"] : s["end"]] = True
                raw, at, left = data.tobytes(), 0, []
                for a, b in _ranges(flags):
                    if b - a >= min_words:
                        left.append(raw[at : starts[a]])
                        at = ends[b - 1]
                out.append(b"".join([*left, raw[at:]]).decode())
            yield pa.array(out, pa.string())

    return cut


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.8, min_words: int = 1) -> DataFrame:
    """docs without benchmark passages: hit spans of min_words or more are cut out of the text.

    A document whose hit words are more than max_coverage of its words is dropped.  Documents without a hit
    pass unchanged, null texts too.  n_chars, where docs has it, follows a changed text.  Other columns pass, whatever their names.
    """
    found = hits(docs, benchmark, window)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"), F.md5(_text()).alias("digest")).join(found, "digest", "left")
    hit = F.col("spans").isNotNull()
    rows = rows.where(~hit | (_covered(F.col("spans")) <= max_coverage * _n_words()))
    same = rows.where(~hit).withColumn("clean", F.col("text"))
    changed = rows.where(hit).withColumn("clean", _cut(min_words)(F.col("text").cast("string"), F.col("spans")))
    columns: list[Column] = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("clean").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(hit, F.length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col(f"row.`{c}`"))
    return same.unionByName(changed).select(*columns)


def op3_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contamination of every document by the benchmark."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
