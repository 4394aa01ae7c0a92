"""Quality classifier: a sparse ensemble of rules over text statistics.

The statistics are Spark expressions.  On a bounded sample of labelled rows, small trees are
grown on bootstrap samples, and every path from a root becomes a rule: a conjunction of
thresholds.  A lasso logistic regression (proximal gradient) keeps few rules; these are compiled
into one Spark column expression, so scoring is a projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import GAP, bounded_choice, count_words, text_or_empty


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text as expressions; all are 0 for an empty text."""

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    def only(characters: str) -> Column:
        return F.length(F.regexp_replace(marks, f"[^{characters}]+", ""))

    # what is neither letter nor white space is little, and is searched several times
    marks = F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", "")

    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    solid = F.length(F.regexp_replace(text, GAP, ""))
    n_words = count_words(text)
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": share(solid, n_words),
        "upper_share": share(F.length(F.regexp_replace(text, r"\P{Lu}+", "")), solid),
        "symbol_share": share(only(r"#*$%&|<>{}=_~^"), solid),
        "shout_share": share(only("!"), solid),
        "digit_share": share(only("0-9"), solid),
        "stop_share": share(only(".,;:?"), solid),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "words_a_line": share(n_words, F.size(lines)),
    }


NAMES = [
    "log_words", "word_length", "upper_share", "symbol_share", "shout_share",
    "digit_share", "stop_share", "distinct_words", "distinct_lines", "words_a_line",
]


@dataclass
class Rule:
    """``weight`` counts where every (statistic, above, threshold) holds."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass
class RuleModel:
    rules: list[Rule]
    intercept: float

    def score(self, columns: dict[str, Column]) -> Column:
        total = F.lit(float(self.intercept))
        for rule in self.rules:
            holds = F.lit(True)
            for name, above, threshold in rule.tests:
                test = columns[name] > F.lit(threshold) if above else columns[name] <= F.lit(threshold)
                holds = holds & test
            total = total + F.when(holds, F.lit(float(rule.weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x, y, depth, thresholds, tests, paths, least):
    """Appends the path of every node below, by the split with the largest Gini gain."""
    n, ones = len(y), y.sum()
    if depth == 0 or n < 2 * least or ones in (0, n):
        return
    best = (1e-9, None)
    for j, cuts in enumerate(thresholds):
        above = x[:, j, None] > cuts
        count, hits = above.sum(0), (above & (y[:, None] > 0)).sum(0)
        rest, misses = n - count, ones - hits
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = hits**2 / count + misses**2 / rest
        gain = np.where((count >= least) & (rest >= least), gain - ones**2 / n, -1.0)
        k = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[k] > best[0]:
            best = (gain[k], (j, float(cuts[k])))
    if best[1] is None:
        return
    j, cut = best[1]
    side = x[:, j] > cut
    for above, mask in ((False, ~side), (True, side)):
        path = (*tests, (j, above, cut))
        paths.add(path)
        _grow(x[mask], y[mask], depth - 1, thresholds, path, paths, least)


def _holds(x: np.ndarray, path) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in path:
        out &= (x[:, j] > cut) if above else (x[:, j] <= cut)
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, k = z.shape
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(z @ v + c))) - y
        moved = v - step * (z.T @ error / n)
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_b = c - step * error.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new_w + (t - 1) / new_t * (new_w - w)
        c = new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, float(b)


def fit_rules(
    x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 7
) -> RuleModel:
    """With no rows, or rows of one class only, the score is constant: 0.5, or the share of ones
    after one row of each class is added."""
    if len(y) == 0 or y.min() == y.max():
        prior = (y.sum() + 1) / (len(y) + 2)
        return RuleModel([], float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    thresholds = []
    for j in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 34)[1:-1]))
        thresholds.append(edges[edges < x[:, j].max()])
    paths: set = set()
    half = max(2, len(y) // 2)
    for _ in range(trees):
        rows = rng.choice(len(y), half, replace=True)
        some = rng.permutation(x.shape[1])[: max(3, x.shape[1] * 2 // 3)]
        allowed = [thresholds[j] if j in some else thresholds[j][:0] for j in range(x.shape[1])]
        _grow(x[rows], y[rows], depth, allowed, (), paths, max(2, half // 200))
    ordered = sorted(paths)
    z = np.stack([_holds(x, p) for p in ordered], 1).astype(float) if ordered else np.zeros((len(y), 0))
    if z.shape[1]:
        _, first = np.unique(z, axis=1, return_index=True)
        first = np.sort(first)
        z, ordered = z[:, first], [ordered[i] for i in first]
        w, b = _lasso(z, y.astype(float), penalty, 600)
    else:
        w, b = np.zeros(0), float(np.log(y.mean() / (1 - y.mean())))
    rules = [
        Rule(tuple((NAMES[j], above, cut) for j, above, cut in path), float(weight))
        for path, weight in zip(ordered, w)
        if weight != 0
    ]
    return RuleModel(rules, b)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """``text`` and ``y`` of at most ``rows`` labels of documents, the first by a hash of the id.

    ``train`` selects the label rows to learn from.  Labels of other documents do not count, equal
    label rows count once, and an id with two labels has two rows.  The choice is made among ids,
    before texts are read, so the side that is broadcast has at most ``rows`` rows.
    """
    known = labels.where(train & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(
        "doc_id", F.col(label).cast("double").alias("y")
    )
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = bounded_choice(there, rows).withColumnRenamed("doc_id", "__id")
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
        .select("doc_id", "text", "y")
    )


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, max_rows: int = 4000, **options) -> RuleModel:
    """Fits on at most ``max_rows`` labelled rows; only their statistics reach the driver."""
    sample = labelled_sample(docs, labels, "quality", train_rows, max_rows)
    stats = sample.select("doc_id", "y", *[c.alias(n) for n, c in statistics(text_or_empty()).items()])
    rows = stats.orderBy(F.xxhash64("doc_id"), "doc_id", "y", *NAMES).limit(max_rows).collect()
    x = np.array([[float(r[n]) for n in NAMES] for r in rows]).reshape(len(rows), len(NAMES))
    y = np.array([r["y"] for r in rows])
    return fit_rules(x, (y > 0.5).astype(int) if len(y) else y, **options)


def with_score(docs: DataFrame, model: RuleModel, name: str = "score") -> DataFrame:
    """``docs`` plus the score of each whole text, in place of a column of that name; a null text
    counts as empty.

    The statistics are computed once per row into a struct that the rules read from.
    """
    columns = statistics(text_or_empty())
    stats = F.struct(*[c.cast("double").alias(n) for n, c in columns.items()])
    held = "__stats"
    while held in docs.columns:
        held += "_"
    rows = docs.drop(name).withColumn(held, stats)
    read = {n: F.col(held)[n] for n in NAMES}
    return rows.withColumn(name, model.score(read)).drop(held)
