"""Language identification: a bidirectional gated recurrent network over bytes.

A text is lower-cased and cut into runs of letters (at most 24; longer runs are cut on).  The
network reads the bytes of a run between two spaces in both directions and labels every position
with a distribution over languages.  A document's probabilities are the mean over all its
positions.  As a run is labelled by itself, a task labels each distinct run once and remembers it.

It is trained in NumPy, by backpropagation through time, on runs of a bounded sample of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import gru
from faultline.llm.common import bounded_choice, ship, slices

LONGEST = 24
RUN = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
UNKNOWN = "und"


def letter_runs(text: str) -> list[str]:
    """Runs of letters of a text; numerals such as "½" or "Ⅷ" are none."""
    runs = RUN.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [r for run in runs for r in "".join(c if c.isalpha() else " " for c in run).split()]


class LanguageModel:
    def __init__(self, languages: list[str], hidden: int = 16, seed: int = 11, memory: int = 200_000):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden, self.memory = languages, hidden, memory
        k = len(languages)
        self.weights = {
            "ahead": gru.initial(rng, 256, 3 * hidden, scale=0.3),
            "back": gru.initial(rng, 256, 3 * hidden, scale=0.3),
            "ahead_again": gru.initial(rng, hidden, 3 * hidden),
            "back_again": gru.initial(rng, hidden, 3 * hidden),
            "out": gru.initial(rng, 2 * hidden, k),
            "bias": np.zeros(k, np.float32),
        }
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sums = np.zeros((0, len(self.languages)), np.float32)
        self.sizes = np.zeros(0, np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "sums", "sizes")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def _label(self, rows: np.ndarray, keep: bool = False):
        """Probabilities (steps, rows, languages) for rows of bytes of one length."""
        w = self.weights
        ahead = gru.forward(w["ahead"][rows.T], w["ahead_again"], keep)
        back = gru.forward(w["back"][rows.T[::-1]], w["back_again"], keep)
        a, b = (ahead[0], back[0]) if keep else (ahead, back)
        both = np.concatenate([a, b[::-1]], 2)
        logits = both @ w["out"] + w["bias"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        return (p, both, ahead[1], back[1]) if keep else p

    def fit(self, runs: list[str], labels: np.ndarray, epochs: int = 3, batch: int = 256, rate: float = 0.01, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        groups = _by_length(runs)
        adam = gru.Adam(self.weights, rate)
        total = epochs * sum(-(-len(at) // batch) for at, _ in groups)
        done = 0
        for _ in range(epochs):
            batches = []
            for at, rows in groups:
                order = rng.permutation(len(at))
                batches += [(at[order[i : i + batch]], rows[order[i : i + batch]]) for i in range(0, len(at), batch)]
            for i in rng.permutation(len(batches)):
                at, rows = batches[i]
                adam.rate = rate * (1 - 0.95 * done / total)
                adam.update(self._gradients(rows, labels[at]))
                done += 1

    def _gradients(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w, h = self.weights, self.hidden
        p, both, kept_ahead, kept_back = self._label(rows, True)
        error = p.copy()
        error[:, np.arange(len(rows)), labels] -= 1
        error /= error.shape[0] * error.shape[1]
        flat = error.reshape(-1, error.shape[2])
        d_both = error @ w["out"].T
        d_ahead, g_ahead = gru.backward(d_both[:, :, :h], w["ahead_again"], kept_ahead)
        d_back, g_back = gru.backward(d_both[::-1, :, h:], w["back_again"], kept_back)
        return {
            "out": both.reshape(-1, 2 * h).T @ flat,
            "bias": flat.sum(0),
            "ahead": gru.sum_rows(rows.T.ravel(), d_ahead.reshape(-1, 3 * h), 256),
            "back": gru.sum_rows(rows.T[::-1].ravel(), d_back.reshape(-1, 3 * h), 256),
            "ahead_again": g_ahead,
            "back_again": g_back,
        }

    def _learn(self, runs: list[str]) -> None:
        """Sums over the positions of new runs."""
        sums = np.empty((len(runs), len(self.languages)), np.float32)
        sizes = np.empty(len(runs), np.float32)
        for at, rows in _by_length(runs):
            for i in range(0, len(at), 2048):
                sums[at[i : i + 2048]] = self._label(rows[i : i + 2048])[1:-1].sum(0)
            sizes[at] = rows.shape[1] - 2
        first = len(self.sizes)
        self.sums, self.sizes = np.concatenate([self.sums, sums]), np.concatenate([self.sizes, sizes])
        self.place.update(zip(runs, range(first, first + len(runs))))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its pooled probability per text; ``und`` and 0 without a letter."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        if len(self.place) > self.memory:
            self.forget()
        found = [letter_runs(t) for t in texts]
        counts = np.array([len(f) for f in found])
        flat = [r for f in found for r in f]
        new = [r for r in dict.fromkeys(flat) if r not in self.place]
        if new:
            self._learn(new)
        index = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        some = np.flatnonzero(counts)
        languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            pooled = np.add.reduceat(self.sums[index].astype(np.float64), starts, axis=0)
            sizes = np.add.reduceat(self.sizes[index].astype(np.float64), starts)
            pooled /= sizes[:, None]
            best = pooled.argmax(1)
            for i, b, p in zip(some.tolist(), best.tolist(), pooled.max(1).tolist()):
                languages[i], scores[i] = self.languages[b], min(p, 1.0)
        return languages, scores


def _by_length(runs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and bytes (a space before and after) of runs, by number of bytes."""
    raw = [b" " + r.encode() + b" " for r in runs]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    out = []
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        joined = b"".join(raw[i] for i in at.tolist())
        out.append((at, np.frombuffer(joined, np.uint8).reshape(-1, size)))
    return out


def training_runs(docs: DataFrame, learn: Column, per_language: int, runs: int, max_rows: int) -> list:
    """``lang`` and up to ``runs`` distinct runs, picked by hash from the whole text, of at most
    ``per_language`` documents of each language (the first by a hash of the id) and ``max_rows``
    documents in all."""
    known = docs.where(
        learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    ).select("doc_id", "lang")
    chosen = bounded_choice(bounded_choice(known, per_language, "lang"), max_rows).select(
        F.col("doc_id").alias("__id"), F.col("lang").alias("__lang")
    )
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{1,%d})" % LONGEST))
    hashed = F.transform(F.array_distinct(letters), lambda r: F.struct(F.xxhash64(r).alias("h"), r.alias("r")))
    picked = F.transform(F.slice(F.array_sort(hashed), 1, runs), lambda x: x["r"])
    return (
        docs.select("doc_id", "text", "lang")
        .join(F.broadcast(chosen), (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang")))
        .select("doc_id", "lang", picked.alias("runs"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "runs")
        .limit(max_rows)
        .collect()
    )


def train(
    docs: DataFrame,
    learn: Column,
    per_language: int = 400,
    runs: int = 48,
    max_rows: int = 8000,
    hidden: int = 16,
    epochs: int = 3,
) -> LanguageModel:
    rows = training_runs(docs, learn, per_language, runs, max_rows)
    languages = sorted({r["lang"] for r in rows})
    number = {l: i for i, l in enumerate(languages)}
    pairs = [(x, number[r["lang"]]) for r in rows for x in r["runs"] if x.isalpha()]
    model = LanguageModel(languages, hidden)
    if pairs:
        model.fit([x for x, _ in pairs], np.array([y for _, y in pairs]), epochs)
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``; columns of these names are replaced.

    A null text, an empty one and one without a letter are ``und`` with score 0, as is every text
    where there was nothing to learn from.  Rows are independent.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            languages: list[str] = []
            scores: list[np.ndarray] = [np.zeros(0)]
            for first, last in slices(column, 2 << 20):
                texts = [t or "" for t in column.slice(first, last - first).to_pylist()]
                some, values = held.value.predict(texts)
                languages += some
                scores.append(values)
            made = [pa.array(languages, pa.string()), pa.array(np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return docs.mapInArrow(run, schema)
