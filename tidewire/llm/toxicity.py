"""Toxicity scores from a support vector machine over subsequence string kernels.

A text is a bag of units: its lower-cased tokens without punctuation, spelled-out runs of single characters, and overlapping
windows of tokens that are long.  The gap-weighted subsequence kernel compares a unit with a landmark: every common
subsequence of three characters counts, discounted by the span it takes in both, so that inserted characters weaken a
match but don't end it.  Landmarks are words that set apart toxic training texts.  A text's kernel value with a
landmark is the largest over its units; the Nyström map of these values is the input of a linear
machine with squared hinge loss, whose margins a sigmoid turns into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import kernels as K

U64 = np.uint64
#: Labelled rows that training takes at most, by the hash of their ids, and the number of landmarks.
SAMPLE_ROWS, LANDMARKS = 20_000, 32
SAMPLE_SENTENCES = 100_000
ORDER, DECAY = 3, 0.8
#: Powers of a kernel are kernels; this one sets whole matches apart from the many weak ones of a long text.
POWER = 4
WIDE, STRIDE = 32, 16
#: A unit's kernel value with a landmark counts as 0 unless it has this share of the landmark's characters, and reaches the floor.
SHARED, FLOOR = 0.75, 0.4
CUTOFF = 0.7
#: Bytes that are left out of units: ASCII that is no letter or digit.
MARKS = bytes(b for b in range(128) if not K.LETTERS[b])
#: Units that a worker remembers before it begins anew; only speed depends on it.
KEPT_UNITS = 2_000_000


def subsequence_kernel(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The gap-weighted subsequence kernel of row pairs of two padded byte matrices with lengths nx and ny."""
    n, wx, wy = len(x), x.shape[1], y.shape[1]
    square = decay * decay
    inside_y = np.arange(wy)[None, :] < ny[:, None]
    # tails[i][:, j]: weight of common subsequences of i characters of the prefixes so far, up to column j
    tails = [np.ones((n, wy + 1)), *(np.zeros((n, wy + 1)) for _ in range(order - 1))]
    total = np.zeros(n)
    for i in range(wx):
        live = nx > i
        if not live.any():
            break
        same = (x[:, i : i + 1] == y) & inside_y & live[:, None]
        total += square * (same * tails[order - 1][:, :wy]).sum(axis=1)
        for k in range(order - 1, 0, -1):
            step, run = square * (same * tails[k - 1][:, :wy]), np.zeros(n)
            grown = tails[k] * decay
            for j in range(wy):
                run = decay * run + step[:, j]
                grown[:, j + 1] += run
            tails[k] = np.where(live[:, None], grown, tails[k])
    return total


def padded(units: list[bytes], width: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), np.uint8).reshape(len(units), width)
    return flat, np.array([len(u) for u in units], np.int64)


def letters(cells: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Counts of a-z, digits and other bytes (by their last bits) of each row."""
    slot = np.where((cells >= 97) & (cells <= 122), cells - 97, np.where(cells >= 128, 26 + (cells & 15), 42 + (cells & 15))).astype(np.int64)
    n, w = cells.shape
    at = (np.arange(n)[:, None] * 58 + slot)[np.arange(w)[None, :] < lengths[:, None]]
    return np.bincount(at, minlength=n * 58).reshape(n, 58).astype(np.int8)


class Landmarks:
    """Landmark words with what comparisons with them need."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.cells, self.lengths = padded(words, max([1, *map(len, words)]))
        self.own = subsequence_kernel(self.cells, self.lengths, self.cells, self.lengths)
        self.letters = letters(self.cells, self.lengths)
        self.need = np.ceil(SHARED * self.lengths).astype(np.int64)

    def values(self, units: list[bytes]) -> np.ndarray:
        """Normalised kernel values of units with landmarks, with the gates."""
        out = np.zeros((len(units), len(self.words)), np.float32)
        if not units:
            return out
        cells, lengths = padded(units)
        have = letters(cells, lengths)
        shared = np.zeros(out.shape, np.int16)
        for c in np.flatnonzero(self.letters.any(axis=0)):
            shared += np.minimum(have[:, c : c + 1], self.letters[None, :, c])
        rows, marks = np.nonzero((shared >= self.need[None, :]) & (lengths[:, None] >= ORDER))
        if not len(rows):
            return out
        # a long unit is also compared by its beginning, as long as the landmark and one more
        cut = np.flatnonzero(lengths[rows] > self.lengths[marks] + 2)
        cells = np.concatenate([cells, cells[rows[cut]]])
        lengths = np.concatenate([lengths, self.lengths[marks[cut]] + 1])
        target = np.concatenate([rows, rows[cut]])
        rows = np.concatenate([rows, len(units) + np.arange(len(cut))])
        marks = np.concatenate([marks, marks[cut]])
        some, where = np.unique(rows, return_inverse=True)
        own = np.zeros(len(some))
        for width in (8, 16, WIDE):
            part = np.flatnonzero((lengths[some] <= width) & (own == 0))
            c, n = cells[some[part], :width], lengths[some[part]]
            own[part] = subsequence_kernel(c, n, c, n)
        value = np.zeros(len(rows))
        done = np.zeros(len(rows), bool)
        for width in (8, 16, WIDE):
            part = np.flatnonzero((lengths[rows] <= width) & ~done)
            done[part] = True
            value[part] = subsequence_kernel(cells[rows[part], :width], lengths[rows[part]], self.cells[marks[part]], self.lengths[marks[part]])
        value /= np.sqrt(own[where] * self.own[marks])
        np.maximum.at(out, (target, marks), np.where(value >= FLOOR, value**POWER, 0).astype(np.float32))
        return out


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> list[tuple[int, bytes]]:
    """(text, unit) for runs of three or more one-letter tokens."""
    one = (ends - starts == 1) & K.LETTERS[data[starts]] if len(starts) else np.zeros(0, bool)
    follows = np.zeros(len(starts), bool)
    if len(starts) > 1:
        follows[1:] = one[1:] & one[:-1] & (starts[1:] - ends[:-1] <= 2)
        follows[firsts[1:-1][firsts[1:-1] < len(starts)]] = False
    heads = np.flatnonzero(one & ~follows)
    stops = np.append(np.flatnonzero(~follows), len(starts))
    to = stops[np.searchsorted(stops, heads, "right")] if len(heads) else heads
    out, owner = [], K.owners(firsts)
    for h, t in zip(heads.tolist(), to.tolist()):
        if t - h >= 3:
            word = K.FOLD[data[starts[h:t]]].tobytes()
            out.extend((int(owner[h]), word[i : i + WIDE]) for i in range(0, max(1, len(word) - STRIDE), STRIDE))
    return out


class Units:
    """Features of slices of texts; remembers which units have no value with any landmark."""

    def __init__(self, landmarks: Landmarks) -> None:
        self.landmarks = landmarks
        self.keys, self.rows = np.zeros(0, U64), np.zeros(0, np.int64)
        self.values = np.zeros((0, len(landmarks.words)), np.float32)

    def features(self, column: pa.Array) -> np.ndarray:
        """For each text the largest value of its units with each landmark, then the logarithm of one more than their sum for each hundred units."""
        data, offsets = K.buffers(column)
        starts, ends, firsts = K.words(data, offsets, K.VISIBLE)
        out = np.zeros((len(offsets) - 1, len(self.landmarks.words)), np.float32)
        owner, sums, size = K.owners(firsts), np.zeros_like(out), np.diff(firsts)
        spelled = _spelled(data, starts, ends, firsts)
        long = ends - starts > WIDE
        if long.any():
            lengths = ends[long] - starts[long]
            windows = -(-(lengths - WIDE) // STRIDE) + 1
            begin = np.repeat(starts[long], windows) + STRIDE * K.ragged(np.zeros(len(windows), np.int64), windows)
            owner = np.concatenate([owner[~long], np.repeat(owner[long], windows)])
            to = np.minimum(begin + WIDE, np.repeat(ends[long], windows))
            starts, ends = np.concatenate([starts[~long], begin]), np.concatenate([ends[~long], to])
        keys = K.span_hashes(data, starts, ends)
        fresh, where, which = np.unique(keys, return_index=True, return_inverse=True)
        at = K.membership(fresh, self.keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.keys) > KEPT_UNITS:
                self.__init__(self.landmarks)
                new = np.arange(len(fresh))
            folded = K.FOLD[data].tobytes()
            values = np.concatenate([self.landmarks.values([folded[s:e].translate(None, MARKS) for s, e in zip(starts[where[i]].tolist(), ends[where[i]].tolist())]) for i in np.array_split(new, len(new) // 20_000 + 1)])
            useful = values.any(axis=1)
            rows = np.where(useful, len(self.values) + np.cumsum(useful) - 1, -1)
            self.values = np.concatenate([self.values, values[useful]])
            every = np.concatenate([self.keys, fresh[new]])
            order = np.argsort(every, kind="stable")
            self.keys, self.rows = every[order], np.concatenate([self.rows, rows])[order]
            at = K.membership(fresh, self.keys)
        row = self.rows[at][which] if len(which) else np.zeros(0, np.int64)
        hit = row >= 0
        np.maximum.at(out, owner[hit], self.values[row[hit]])
        np.add.at(sums, owner[hit], self.values[row[hit]])
        for text, unit in spelled:
            value = self.landmarks.values([unit])[0]
            out[text], sums[text] = np.maximum(out[text], value), sums[text] + value
        return np.hstack([out, np.log1p(100 * sums / (size[:, None] + 20))])


def _widened(landmarks: Landmarks, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Virtual examples: each full match of a landmark is replaced by one of that landmark with a character inserted."""
    n = len(landmarks.words)
    out = x.copy()
    out[:, :n][x[:, :n] > 0.999] = 0
    variants = []
    for word in landmarks.words:
        at = int(rng.integers(1, max(2, len(word))))
        variants.append(word[:at] + bytes([b"-.*_x0"[int(rng.integers(6))]]) + word[at:])
    near = landmarks.values(variants)
    for j in range(len(landmarks.words)):
        rows = x[:, j] > 0.999
        out[rows, :n] = np.maximum(out[rows, :n], near[j][None, :])
    return out


def machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 5.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by Newton steps; y is 1 or -1."""
    x = np.hstack([z, np.ones((len(z), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        after = np.linalg.solve(ridge + cost * 2 * a.T @ x[inside], cost * 2 * a.T @ y[inside])
        if np.allclose(after, w, atol=1e-9):
            break
        steps = [w + (after - w) * 0.5**k for k in range(12)]
        w = min(steps, key=lambda v: v @ ridge @ v / 2 + cost * (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum())
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a m + b))) fits smoothed 0/1 targets, by Newton steps."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, np.log((up + 1) / (down + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def mapped(features: np.ndarray, project: np.ndarray) -> np.ndarray:
    """The Nyström map of both halves of features."""
    n = len(project)
    return np.hstack([features[:, :n].astype(float) @ project, features[:, n:].astype(float) @ project])


@dataclass
class Model:
    landmarks: Landmarks
    project: np.ndarray
    weights: np.ndarray
    scale: float
    shift: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not len(self.landmarks.words):
            return np.full(len(features), 1 / (1 + np.exp(-self.shift)))
        margin = mapped(features, self.project) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30)))


def _featured(landmarks: Landmarks):
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(landmarks)
        for part in K.slices(batches, "text"):
            x = units.features(part.column("text"))
            flat = pa.array(x.ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("fold"), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], flat)], ["toxic", "fold", "x"])

    return featured


def _chosen(z: dict[str, float], count: int) -> list[str]:
    """The words of greatest z, of a word and its beginnings only one: the longest that loses at most 15 % to them."""
    kept: list[str] = []
    for word in sorted(z, key=lambda w: (-len(w), w)):
        longer = [w for w in kept if w.startswith(word)]
        if any(z[w] >= 0.85 * z[word] for w in longer):
            continue
        kept = [w for w in kept if not w.startswith(word)] + [word]
    return sorted(kept, key=lambda w: (-z[w], w))[:count]


def _collected(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels (1 or -1) and folds of a bounded table, in an order that only its values give."""
    got = rows.toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, width).astype(float)
    y = np.where(got.column("toxic").to_numpy() == 1, 1.0, -1.0)
    fold = got.column("fold").to_numpy()
    order = np.lexsort([*x.T, fold, y])
    return x[order], y[order], fold[order]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, sample_sentences: int = SAMPLE_SENTENCES) -> Model:
    """A model of documents (doc_id, text) with labels (doc_id, toxic 0/1).

    A sentence has its text's label.  The machine learns from sentences that have a value with some
    landmark; the sigmoid from whole texts, by cross-validation.  At most sample_rows labelled rows are
    taken, those whose ids have the least hashes, and at most sample_sentences of their sentences; of documents that share an id
    and a label one is taken; rows with a null id or label are left out.  Without rows of both labels every text gets the smoothed share of toxic rows.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "toxic").limit(sample_rows)
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    first = F.row_number().over(Window.partitionBy("doc_id", "toxic").orderBy(F.xxhash64("text"), "text"))
    rows = K.kept(found.withColumn("__n", first).where("__n = 1").select("text", "toxic", (F.xxhash64("doc_id") % 3).cast("int").alias("fold")), "labelled")
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    up, down = counts.get(1, 0), counts.get(0, 0)
    nothing = Model(Landmarks([]), np.zeros((0, 0)), np.zeros(1), 0.0, float(np.log((up + 1) / (down + 1))))
    if not up or not down:
        return nothing
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}][\\p{L}\\p{N}]{3,15}"), F.lit(0)))
    stems = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.array(*map(F.lit, (5, 6, 7, 16))), lambda n: F.substring(w, F.lit(1), n)))))
    found = rows.select("toxic", F.explode(stems).alias("word")).groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("b"))
    p, q = F.col("a") / up, F.col("b") / down
    spread = F.sqrt((F.col("a") + F.col("b") + 1) / F.lit(up + down) * (1 / up + 1 / down))
    top = found.where("a >= 2").where(p > 2.5 * q).select("word", ((p - q) / spread).alias("z")).orderBy(F.desc("z"), "word").limit(40 * landmarks).collect()
    words = _chosen({r.word: r.z for r in top}, landmarks)
    marks = Landmarks([w.encode()[:WIDE] for w in words])
    if not words:
        return nothing
    sentences = rows.select("toxic", "fold", F.explode(F.split("text", "(?<=[.!?])\\s+|\n")).alias("text"))
    named = sentences.mapInArrow(_featured(marks), "toxic int, fold int, x array<float>").where(F.exists("x", lambda v: v > 0))
    named = named.orderBy(F.xxhash64("x", "fold", "toxic")).limit(sample_sentences)
    x, y, fold = _collected(named, 2 * len(words))
    whole, truth, whole_fold = _collected(rows.mapInArrow(_featured(marks), "toxic int, fold int, x array<float>"), 2 * len(words))
    # of sentences only whole matches count, at a text's density; whole texts are learned from too
    x[:, len(words) :] = np.minimum(x[:, len(words) :], np.log1p(100 * x[:, : len(words)] / 120))
    x, y, fold = np.vstack([x, whole]), np.append(y, truth), np.append(fold, whole_fold)
    rng = np.random.default_rng(0)
    wide = np.vstack([x, _widened(marks, x, rng)])
    grown = np.tile(y, 2)
    weight = np.ones(len(grown))
    own = np.array([subsequence_kernel(np.repeat(marks.cells[j : j + 1], len(words), 0), np.repeat(marks.lengths[j : j + 1], len(words)), marks.cells, marks.lengths) for j in range(len(words))])
    own = (own / np.sqrt(np.outer(marks.own, marks.own))) ** POWER
    values, vectors = np.linalg.eigh(own)
    keep = values > 1e-6
    project = vectors[:, keep] / np.sqrt(values[keep])
    z, folds, margin = mapped(wide, project), np.tile(fold, 2), np.zeros(len(truth))
    for f in np.unique(whole_fold):
        w = machine(z[folds != f], grown[folds != f], weight[folds != f])
        margin[whole_fold == f] = mapped(whole[whole_fold == f], project) @ w[:-1] + w[-1]
    scale, shift = sigmoid_fit(margin, truth)
    return Model(marks, project, machine(z, grown, weight), max(scale, 1e-3), shift)


def _scored(shared):
    units: list[Units] = []

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        if not units:
            units.append(Units(model.landmarks))
        for column in batches:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            parts = [model.scores(units[0].features(part.column("text"))) for part in K.slices([batch], "text")]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return F.arrow_udf(scored, "double")


def scorer(spark: SparkSession, model: Model):
    """A function from a text column to the column of its scores, from 0 to 1; null counts as empty."""
    udf = _scored(spark.sparkContext.broadcast(model))
    return lambda text: udf(F.coalesce(F.col(text).cast("string"), F.lit("")))


def held_out(column: str = "doc_id") -> Column:
    """Whether labels of a row aren't learned from: its crc32(doc_id as text) mod 3 is 1; true for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """docs with the columns score and predicted (1 where score >= cutoff), learned from the labels not held out.

    Every row gets a score, null and empty texts and repeated rows too.  Existing columns of these names
    are replaced.
    """
    model = train(docs, labels.where(~held_out()))
    return docs.withColumn("score", scorer(docs.sparkSession, model)("text")).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def op7_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", held_out().alias("held_out"), "score", "predicted")
