"""Toxicity: a bidirectional gated recurrent network with attention pooling, over windows.

A word enters as two vectors: one for the word (hashed) and one for its characters (the mean of
hashed runs of three to five characters, ends marked).  Windows of ``width`` words begin every
``stride`` words, so they overlap, and the last ends with the text.  The network reads a window
in both directions, attention pools the states, and a logistic unit scores the window.  A
document's score is the largest window score, calibrated on the training documents.

Labels hold for documents, so training alternates between choosing windows (the highest-scoring
one of each document, with more from untoxic ones) and fitting them.  The first choice goes by the log odds
of character runs between toxic and other documents.  All of it is NumPy.

It learns from a bounded number of labelled documents of any length.  Spark tasks read every window
of them, for each choice and for calibration; only chosen windows come to the driver: one of a
toxic document, of another the three that score highest and up to ``extra`` drawn by a hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import gru
from faultline.llm.common import bounded_choice, cut, ship, slices

WORD = re.compile(r"\w+")
WORD_ROWS, GRAM_ROWS, GRAMS = 1 << 13, 1 << 14, (3, 4, 5)
#: Partitions of the documents to learn from.
PARTS = 24


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character runs of words with marked ends, and the word each belongs to.

    A run is hashed from its code points; a run is never longer than its marked word.
    """
    marked = [f"^{w}$" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    rows, owners = [], []
    for n in GRAMS:
        total = np.full(max(len(points) - n + 1, 0), n, np.uint64)
        for k in range(n if len(total) else 0):
            total = (total ^ points[k : k + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        whole = np.flatnonzero(of[: len(total)] == of[n - 1 :])
        rows.append((total[whole] % np.uint64(GRAM_ROWS)).astype(np.int64))
        owners.append(of[whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(rows)[order], owner[order]


def _word_row(word: str) -> int:
    return zlib.crc32(word.encode()) & (WORD_ROWS - 1)


class ToxicityModel:
    def __init__(self, hidden: int = 12, size: int = 8, width: int = 24, stride: int = 16, seed: int = 3, memory: int = 150_000):
        rng = np.random.default_rng(seed)
        self.hidden, self.size, self.width, self.stride, self.memory = hidden, size, width, stride, memory
        self.weights = {
            "word": gru.initial(rng, WORD_ROWS, size, scale=0.05),
            "gram": gru.initial(rng, GRAM_ROWS, size, scale=0.2),
            "ahead": gru.initial(rng, 2 * size, 3 * hidden),
            "back": gru.initial(rng, 2 * size, 3 * hidden),
            "ahead_bias": np.zeros(3 * hidden, np.float32),
            "back_bias": np.zeros(3 * hidden, np.float32),
            "ahead_again": gru.initial(rng, hidden, 3 * hidden),
            "back_again": gru.initial(rng, hidden, 3 * hidden),
            "attend": gru.initial(rng, 2 * hidden, hidden),
            "attend_out": gru.initial(rng, hidden),
            "out": gru.initial(rng, 2 * hidden),
            "bias": np.zeros(1, np.float32),
        }
        self.slope, self.shift = 1.0, 0.0
        self.constant: float | None = None
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.vectors = np.zeros((1, 2 * self.size), np.float32)  # row 0 fills windows up

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "vectors")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    # words and windows

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word row, and gram rows with the word each belongs to."""
        own = np.array([_word_row(w) for w in words], np.int64)
        return own, *gram_rows(words)

    def _embed(self, ids) -> np.ndarray:
        own, flat, of = ids
        counts = np.bincount(of, minlength=len(own)).astype(np.float32)
        starts = (np.cumsum(counts) - counts).astype(np.int64)
        characters = np.add.reduceat(self.weights["gram"][flat], starts, axis=0) / np.sqrt(counts)[:, None]
        return np.concatenate([self.weights["word"][own], characters], 1)

    def _learn(self, words: list[str]) -> None:
        first = len(self.vectors)
        made = [self._embed(self._ids(words[i : i + 20_000])) for i in range(0, len(words), 20_000)]
        self.vectors = np.concatenate([self.vectors, *made])
        self.place.update(zip(words, range(first, first + len(words))))

    def _windows(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and length of every window, from the word counts of the texts."""
        w, s = self.width, self.stride
        many = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - w) // s)), 0)
        text = np.repeat(np.arange(len(counts)), many)
        step = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        begin = np.minimum(step * s, np.maximum(counts[text] - w, 0))
        return text, begin, np.minimum(counts[text], w)

    # the network

    def _run(self, vectors: np.ndarray, grid: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows; ``grid`` holds the vector rows (windows, width)."""
        w = self.weights
        steps = grid.T
        ahead = gru.forward((vectors @ w["ahead"] + w["ahead_bias"])[steps], w["ahead_again"], keep)
        back = gru.forward((vectors @ w["back"] + w["back_bias"])[steps[::-1]], w["back_again"], keep)
        a, b = (ahead[0], back[0]) if keep else (ahead, back)
        both = np.concatenate([a, b[::-1]], 2)
        asked = np.tanh(both @ w["attend"])
        weight = asked @ w["attend_out"]
        weight = np.where(np.arange(grid.shape[1])[:, None] < lengths, weight, -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tb,tbh->bh", weight, both)
        logit = pooled @ w["out"] + w["bias"][0]
        return (logit, both, asked, weight, pooled, ahead[1], back[1]) if keep else logit

    def _gradients(self, ids, grid, lengths, labels) -> dict[str, np.ndarray]:
        w, h, size = self.weights, self.hidden, self.size
        own, flat, of = ids
        vectors = np.concatenate([np.zeros((1, 2 * size), np.float32), self._embed(ids)])
        logit, both, asked, weight, pooled, kept_a, kept_b = self._run(vectors, grid, lengths, True)
        d = ((gru.sigmoid(logit) - labels) / len(labels)).astype(np.float32)
        d_pooled = d[:, None] * w["out"]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, both)
        d_both = weight[:, :, None] * d_pooled
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        d_asked = d_score[:, :, None] * w["attend_out"] * (1 - asked * asked)
        d_both = d_both + d_asked @ w["attend"].T
        d_a, g_a = gru.backward(d_both[:, :, :h], w["ahead_again"], kept_a)
        d_b, g_b = gru.backward(d_both[::-1, :, h:], w["back_again"], kept_b)
        steps = grid.T
        sum_a = gru.sum_rows(steps.ravel(), d_a.reshape(-1, 3 * h), len(vectors))
        sum_b = gru.sum_rows(steps[::-1].ravel(), d_b.reshape(-1, 3 * h), len(vectors))
        d_vectors = (sum_a @ w["ahead"].T + sum_b @ w["back"].T)[1:]
        counts = np.bincount(of, minlength=len(own)).astype(np.float32)
        spread = (d_vectors[:, size:] / np.sqrt(counts)[:, None])[of]
        return {
            "word": gru.sum_rows(own, d_vectors[:, :size], WORD_ROWS),
            "gram": gru.sum_rows(flat, spread, GRAM_ROWS),
            "ahead": vectors.T @ sum_a,
            "back": vectors.T @ sum_b,
            "ahead_bias": sum_a.sum(0),
            "back_bias": sum_b.sum(0),
            "ahead_again": g_a,
            "back_again": g_b,
            "attend": both.reshape(-1, 2 * h).T @ d_asked.reshape(-1, h),
            "attend_out": np.einsum("tb,tbh->h", d_score, asked),
            "out": pooled.T @ d,
            "bias": d.sum(keepdims=True),
        }

    # documents

    def largest_logits(self, texts: list[str]) -> tuple[np.ndarray, list]:
        """Largest window logit per text (NaN without words), over all windows."""
        found = [WORD.findall(t.lower()) for t in texts]
        counts = np.array([len(f) for f in found], np.int64)
        if len(self.place) > self.memory:
            self.forget()
        flat = [x for f in found for x in f]
        new = [x for x in dict.fromkeys(flat) if x not in self.place]
        if new:
            self._learn(new)
        rows = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        text, begin, length = self._windows(counts)
        first = (np.cumsum(counts) - counts)[text] + begin
        best = np.full(len(texts), np.nan)
        logits = np.empty(len(text), np.float32)
        for i in range(0, len(text), 1024):
            grid, used = _grid(rows, first[i : i + 1024], length[i : i + 1024], self.width)
            logits[i : i + 1024] = self._run(self.vectors[used], grid, length[i : i + 1024])
        some = np.flatnonzero(counts)
        if len(some):
            begins = np.flatnonzero(np.diff(text, prepend=-1))
            best[some] = np.maximum.reduceat(logits, begins)
        return best, [text, first - (np.cumsum(counts) - counts)[text], length, logits, found]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        best, _ = self.largest_logits(texts)
        value = self.slope * best + self.shift
        # no words: nothing toxic was read
        return np.where(np.isnan(best), 0.0, 1 / (1 + np.exp(-np.clip(np.nan_to_num(value), -60, 60))))

    def choose(self, keys: np.ndarray, texts: list[str], labels: np.ndarray, odds: np.ndarray | None, turn: int, extra: int):
        """Text, first word and words of the windows to learn from, out of all windows of the texts."""
        if odds is None:
            _, (text, begin, length, logits, found) = self.largest_logits(texts)
        else:
            found = [WORD.findall(t.lower()) for t in texts]
            text, begin, length = self._windows(np.array([len(f) for f in found], np.int64))
            logits = _odds_of_windows(found, odds, text, begin, length)
        order = np.lexsort((begin, -logits, text))
        rank = np.arange(len(text)) - np.searchsorted(text[order], text[order])
        toxic = labels[text[order]] > 0.5
        top = order[(rank == 0) | (~toxic & (rank < 3))]
        chance = _chances(keys[text], begin, turn)
        drawn = np.flatnonzero((chance < 0.1) & (labels[text] <= 0.5))
        drawn = drawn[np.lexsort((chance[drawn], text[drawn]))]
        drawn = drawn[np.arange(len(drawn)) - np.searchsorted(text[drawn], text[drawn]) < extra]
        chosen = np.unique(np.concatenate([top, drawn]))
        words = [found[text[k]][begin[k] : begin[k] + length[k]] for k in chosen.tolist()]
        return text[chosen], begin[chosen], words

    def fit(self, sample: DataFrame, odds: float = 0.0, rounds: int = 3, epochs: int = 3, rate: float = 0.01, extra: int = 16) -> None:
        """``sample`` has ``key``, ``text`` and ``y``; its texts stay in the tasks.

        ``odds``: log odds of a toxic label, to calibrate for if the classes were sampled.
        """
        runs, worded, labels = run_counts(sample)
        if not worded.all():
            self.constant = float((labels[1] + 1) / (labels.sum() + 2))
            return
        rng = np.random.default_rng(17)
        adam = gru.Adam(self.weights, rate)
        first = _run_odds(runs, labels)
        for turn in range(rounds):
            self.forget()
            windows, y = chosen_windows(sample, self, None if turn else first, turn, extra)
            self._fit_windows(windows, y, adam, epochs, rng)
        self.forget()
        best, y = document_logits(sample, self)
        self._calibrate(best, y, odds)
        self.forget()

    def _fit_windows(self, windows, y, adam, epochs, rng, batch: int = 128) -> None:
        length = np.array([len(w) for w in windows], np.int64)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                words: dict[str, int] = {}
                grid = np.zeros((len(some), self.width), np.int64)
                for j, k in enumerate(some.tolist()):
                    grid[j, : length[k]] = [words.setdefault(x, len(words) + 1) for x in windows[k]]
                ids = self._ids(list(words))
                adam.update(self._gradients(ids, grid, length[some], y[some]))

    def _calibrate(self, logits: np.ndarray, labels: np.ndarray, odds: float) -> None:
        """Slope and shift by Newton steps; the sample's own odds are replaced by ``odds``."""
        theta = np.array([1.0, 0.0])
        x = np.stack([logits, np.ones(len(logits))], 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            gradient = x.T @ (p - labels) / len(labels) + np.array([1e-3 * (theta[0] - 1), 0])
            bend = (x * (p * (1 - p))[:, None]).T @ x / len(labels) + 1e-3 * np.eye(2)
            step = np.linalg.solve(bend, gradient)
            theta = theta - np.clip(step, -1, 1)
        theta[0] = max(theta[0], 0.05)
        share = labels.mean()
        self.slope, self.shift = float(theta[0]), float(theta[1] + odds - np.log(share / (1 - share)))


def _grid(rows: np.ndarray, first: np.ndarray, length: np.ndarray, width: int):
    """Window places in the vectors they use, and those vectors' rows (0 fills up)."""
    reach = np.arange(width)
    inside = reach < length[:, None]
    place = np.where(inside, rows[np.minimum(first[:, None] + reach, len(rows) - 1)], 0)
    used, grid = np.unique(place, return_inverse=True)
    return grid.reshape(place.shape), used


def _chances(keys: np.ndarray, begin: np.ndarray, turn: int) -> np.ndarray:
    """A number below 1 for each window, from its document, place and the turn."""
    x = keys.astype(np.uint64) ^ (begin.astype(np.uint64) + np.uint64(turn << 40))
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return (x >> np.uint64(11)) / float(1 << 53)


def _runs_of_words(found) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Places of the distinct words, and the rows of their character runs with start and number a word."""
    words = list(dict.fromkeys(w for f in found for w in f))
    rows, of = gram_rows(words) if words else (np.zeros(0, np.int64),) * 2
    many = np.bincount(of, minlength=len(words))
    return {w: i for i, w in enumerate(words)}, rows, np.cumsum(many) - many, many


def _run_odds(runs: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Log odds of each (hashed) character run, counted by documents."""
    (other, toxic), (n0, n1) = runs, labels
    odds = np.log((toxic + 0.1) / (n1 + 0.2)) - np.log((other + 0.1) / (n0 + 0.2)) + 0.3 * np.log1p(toxic)
    odds[toxic < 2] = -9.0
    return odds


def _odds_of_windows(found, odds, text, begin, length) -> np.ndarray:
    """Per window, the largest log odds of a character run."""
    place, rows, starts, _ = _runs_of_words(found)
    of_word = np.maximum.reduceat(odds[rows], starts) if place else np.zeros(0)
    flat = np.fromiter((place[w] for f in found for w in f), np.int64)
    counts = np.array([len(f) for f in found], np.int64)
    first = (np.cumsum(counts) - counts)[text] + begin
    values = of_word[flat]
    return np.array([values[i : i + n].max() for i, n in zip(first.tolist(), length.tolist())], np.float32)


def _texts(batches: Iterator[pa.RecordBatch]):
    """Keys, texts and labels of the rows, in slices of bounded size."""
    for batch in batches:
        for first, last in slices(batch.column("text"), 2 << 20):
            part = batch.slice(first, last - first)
            keys, labels = (part.column(c).to_numpy() for c in ("key", "y"))
            yield keys, [t or "" for t in part.column("text").to_pylist()], labels


def run_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By class: documents that hold each character run, those that hold words, and all documents."""

    def run(batches):
        counts = np.zeros((2, GRAM_ROWS + 2), np.int64)
        for _, texts, labels in _texts(batches):
            found = [WORD.findall(t.lower()) for t in texts]
            place, rows, starts, many = _runs_of_words(found)
            for f, y in zip(found, labels.tolist()):
                counts[y, -1] += 1
                if f:
                    counts[y, -2] += 1
                    seen = [rows[starts[i] : starts[i] + many[i]] for i in {place[w] for w in f}]
                    counts[y, np.unique(np.concatenate(seen))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    counts = np.zeros((2, GRAM_ROWS + 2), np.int64)
    for row in sample.mapInArrow(run, "counts binary").toLocalIterator():
        counts += np.frombuffer(row["counts"], np.int64).reshape(counts.shape)
    return counts[:, :GRAM_ROWS], counts[:, -2], counts[:, -1]


def chosen_windows(sample: DataFrame, model: ToxicityModel, odds: np.ndarray | None, turn: int, extra: int):
    """Words and labels of the windows to learn from, in an order that does not hang on the tasks."""
    held = sample.sparkSession.sparkContext.broadcast((model, odds))

    def run(batches):
        for keys, texts, labels in _texts(batches):
            model, odds = held.value
            text, begin, words = model.choose(keys, texts, labels, odds, turn, extra)
            arrays = [pa.array(keys[text]), pa.array(begin), pa.array(labels[text]), pa.array([" ".join(w) for w in words], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "begin", "y", "words"])

    rows = sorted(map(tuple, sample.mapInArrow(run, "key bigint, begin bigint, y int, words string").collect()))
    held.destroy()
    return [r[3].split(" ") for r in rows], np.array([r[2] for r in rows], np.float32)


def document_logits(sample: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """Largest logit over all windows, and label, of the documents that hold words."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for keys, texts, labels in _texts(batches):
            best, _ = held.value.largest_logits(texts)
            seen = ~np.isnan(best)
            arrays = [pa.array(keys[seen]), pa.array(labels[seen]), pa.array(best[seen])]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "y", "best"])

    rows = sorted(map(tuple, sample.mapInArrow(run, "key bigint, y int, best double").collect()))
    held.destroy()
    return np.array([r[2] for r in rows]), np.array([r[1] for r in rows], np.float64)


def training_texts(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int) -> DataFrame:
    """``key``, ``text`` and ``y`` of at most ``per_class`` labelled documents of each class, the first
    by a hash of the id, as a checkpoint.  Of rows that share an id, one text is taken."""
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(
        "doc_id", (F.col("toxic") > 0).cast("int").alias("y")
    )
    # ids are read before the choice, texts after it
    there = docs.where(F.col("text").isNotNull()).select("doc_id")
    chosen = bounded_choice(known.join(there, "doc_id", "left_semi"), per_class, "y").withColumnRenamed(
        "doc_id", "__id"
    )
    texts = (
        docs.where(F.col("text").isNotNull())
        .select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
        .groupBy("__id", "y")
        .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("__least"))
        .select(F.xxhash64("__id").alias("key"), "y", F.col("__least.text").alias("text"))
    )
    return cut(texts.repartition(PARTS, "key").sortWithinPartitions("key", "y"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 1200, **options) -> ToxicityModel:
    ship(docs.sparkSession)
    sample = training_texts(docs, labels, learn, per_class)
    model = ToxicityModel()
    count = labels.where(learn & F.col("toxic").isNotNull()).agg(
        F.count(F.when(F.col("toxic") > 0, 1)).alias("ones"), F.count("*").alias("all")
    ).first()
    share = (count["ones"] + 1) / (count["all"] + 2)
    model.fit(sample, float(np.log(share / (1 - share))), **options)
    return model


def with_score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``docs`` plus the score of each whole text; a column of that name is replaced.

    Null and empty texts and texts without words score 0, or the constant of a model that had
    nothing to learn from.  Rows are independent.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            scores: list[np.ndarray] = [np.zeros(0)]
            for first, last in slices(column, 2 << 20):
                texts = [t or "" for t in column.slice(first, last - first).to_pylist()]
                scores.append(held.value.score(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores))], names=schema.names
            )

    return docs.mapInArrow(run, schema)
