"""Benchmark decontamination: a broadcast hash set of benchmark n-grams scans the token windows.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters above ASCII.  An item
gives one window per 13 consecutive words; a shorter item is one window as a whole.  Tasks hash
every word of a text and every window of words with NumPy, look the hashes up in the broadcast
set and compare each find with the window's words, so a hash collision never counts.

The set is broadcast in blocks of at most ``block_windows`` windows and ``block_bytes`` bytes: 16
bytes a window, and the items' bytes once.  A larger benchmark is searched for block after block;
the finds add up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import buffers, cut, ship, slices

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 13

_codes = np.arange(256)
_upper = (_codes >= 0x41) & (_codes <= 0x5A)
LOWER = np.where(_upper, _codes + 32, _codes).astype(np.uint8)
IN_WORD = (
    ((_codes >= 0x30) & (_codes <= 0x39)) | _upper | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)
)
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 20


def words_of(text: str | None) -> list[str]:
    raw = (text or "").encode().translate(LOWER.tobytes())
    return re.findall(TOKEN, raw.decode())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64."""
    base = np.full(n, _BASE, np.uint64)
    inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    base[:1] = inverse[:1] = 1
    return np.cumprod(base), np.cumprod(inverse)


_table: list[tuple[np.ndarray, np.ndarray]] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _table or len(_table[0][0]) < n:
        _table[:] = [_powers(max(n, _STEP + 4096))]
    return _table[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of all texts, in steps that end between words."""
    inside = IN_WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        origin = starts[first]
        last = max(int(np.searchsorted(ends, origin + _STEP, "right")), first + 1)
        chunk = LOWER[raw[origin : ends[last - 1]]].astype(np.uint64) + np.uint64(1)
        power, inverse = _power_table(len(chunk))
        sums = np.zeros(len(chunk) + 1, np.uint64)
        np.cumsum(chunk * power[: len(chunk)], out=sums[1:])
        a, b = starts[first:last] - origin, ends[first:last] - origin
        hashes[first:last] = (sums[b] - sums[a]) * inverse[a]
        first = last
    return starts, ends, _mixed(hashes)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        total += words[k : k + n] * np.uint64((2 * k + 3) * _BASE % (1 << 64) | 1)
    return _mixed(total)


class WindowSet:
    """Benchmark windows by size: their hashes, sorted, and the word each begins at.

    The items stand once, as bytes; a window is compared with the words there.
    """

    def __init__(self, items: list[tuple[str, str | None]], size: int = SIZE):
        self.names = np.array([i for i, _ in items], object)
        self.raw, offsets = buffers(pa.array([t or "" for _, t in items], pa.string()))
        self.starts, self.ends, hashes = word_hashes(self.raw, offsets)
        first = np.searchsorted(self.starts, offsets)
        n_words = np.diff(first)
        self.home = np.repeat(np.arange(len(items)), n_words)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in sorted(set(np.minimum(n_words, size).tolist()) - {0}):
            keys = window_hashes(hashes, width)
            at = np.arange(len(keys))
            # whole items where they are shorter than a window
            right = n_words >= size if width == size else n_words == width
            at = at[right[self.home[at]] & (self.home[at] == self.home[at + width - 1])]
            at = at[np.lexsort((self.home[at], keys[at]))]
            keys = keys[at]
            sieve = np.zeros(1 << 20, bool)
            sieve[keys >> np.uint64(44)] = True
            self.sizes[width] = (keys, sieve, at)

    def _owners(self, places: np.ndarray, width: int, text: bytes) -> list[str]:
        """Items whose window at one of the places reads so; a window of an item is compared once."""
        found = set()
        for place in places.tolist():
            name = self.names[self.home[place]]
            if name not in found and self._text(place, width) == text:
                found.add(name)
        return sorted(found)

    def _text(self, place: int, width: int) -> bytes:
        bounds = zip(self.starts[place : place + width].tolist(), self.ends[place : place + width].tolist())
        return b" ".join([LOWER[self.raw[a:b]].tobytes() for a, b in bounds])

    def scan(self, raw: np.ndarray, offsets: np.ndarray):
        """Word bounds, the text of each word, and verified finds as (first word, size, items)."""
        starts, ends, hashes = word_hashes(raw, offsets)
        home = np.searchsorted(offsets, starts, "right") - 1
        finds = []
        known: dict[tuple[int, bytes], list[str]] = {}
        for width, (keys, sieve, at_word) in self.sizes.items():
            h = window_hashes(hashes, width)
            at = np.flatnonzero(sieve[h >> np.uint64(44)])
            at = at[home[at] == home[at + width - 1]]
            low, high = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], "right")
            for i, a, b in zip(*(x[high > low].tolist() for x in (at, low, high))):
                text = b" ".join(
                    [LOWER[raw[x:y]].tobytes() for x, y in zip(starts[i : i + width], ends[i : i + width])]
                )
                owners = known.get((width, text))
                if owners is None:
                    owners = known[(width, text)] = self._owners(at_word[a:b], width, text)
                if owners:
                    finds.append((i, width, owners))
        return starts, ends, home, finds


def _scan_rows(windows: WindowSet, column: pa.Array, with_text: bool) -> Iterator[dict]:
    for first, last in slices(column):
        part = column.slice(first, last - first)
        raw, offsets = buffers(part)
        starts, ends, home, finds = windows.scan(raw, offsets)
        n_words = np.bincount(home, minlength=last - first)
        first_word = np.concatenate([[0], np.cumsum(n_words)])
        step = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set] = {}
        for i, width, owners in finds:
            step[i] += 1
            step[i + width] -= 1
            items.setdefault(int(home[i]), set()).update(owners)
        covered = np.cumsum(step[:-1]) > 0
        runs: dict[int, list] = {}
        if items:
            padded = np.concatenate([[False], covered, [False]])
            edge = np.flatnonzero(padded[1:] != padded[:-1])
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                while a < b:  # covered words of neighbouring texts may touch
                    text = int(home[a])
                    end = min(b, int(first_word[text + 1]))
                    runs.setdefault(text, []).append((a, end))
                    a = end
        for row in range(last - first):
            found = runs.get(row, [])
            out = {
                "n_words": int(n_words[row]),
                "spans": [{"first": a - int(first_word[row]), "last": b - int(first_word[row])} for a, b in found],
                "items": sorted(items.get(row, ())),
            }
            if with_text:
                cuts = [(int(starts[a]), int(ends[b - 1])) for a, b in found]
                out["clean_text"] = _without(raw, int(offsets[row]), int(offsets[row + 1]), cuts)
            yield out


def _without(raw: np.ndarray, begin: int, end: int, cuts: list[tuple[int, int]]) -> str:
    kept, at = [], begin
    for a, b in cuts:
        kept.append(raw[at:a].tobytes())
        at = b
    kept.append(raw[at:end].tobytes())
    return b"".join(kept).decode()


FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField(
        "spans",
        T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])),
    ),
    T.StructField("items", T.ArrayType(T.StringType())),
]
SPAN_TYPE = "array<struct<first:bigint,last:bigint>>"
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _pass(docs: DataFrame, items: list[tuple[str, str | None]], size: int, with_text: bool) -> DataFrame:
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(WindowSet(items, size))
    schema = T.StructType([*docs.schema.fields, *FOUND])
    if with_text:
        schema = T.StructType([*schema.fields, T.StructField("clean_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_scan_rows(held.value, batch.column("text"), with_text))
            made = [
                pa.array([r["n_words"] for r in rows], pa.int64()),
                pa.array([r["spans"] for r in rows], SPANS),
                pa.array([r["items"] for r in rows], pa.list_(pa.string())),
            ]
            if with_text:
                made.append(pa.array([r["clean_text"] for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def _merged(spans: Column) -> Column:
    """Union of spans, by the words they cover."""

    def add(done, span):
        top = F.try_element_at(done, F.lit(-1))
        touching = F.coalesce(top["last"] >= span["first"], F.lit(False))
        joined = F.struct(
            top["first"].alias("first"), F.greatest(top["last"], span["last"]).alias("last")
        )
        return F.when(
            touching, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPAN_TYPE), add)


def item_pieces(benchmark: DataFrame, size: int = SIZE, piece_bytes: int = 1 << 20) -> DataFrame:
    """``item`` and ``text`` of the items; a long text comes in pieces of about ``piece_bytes`` that
    share ``size`` - 1 words, so each window lies whole in one of them."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text")
    ).where(F.col("text").isNotNull())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                raw = np.frombuffer(text.encode(), np.uint8)
                starts, ends, _ = word_hashes(raw, np.array([0, len(raw)]))
                first, last = 0, 0
                while last < len(starts):
                    last = int(np.searchsorted(ends, starts[first] + piece_bytes, "right"))
                    last = min(max(last, first + size), len(starts))
                    names.append(name)
                    texts.append(raw[starts[first] : ends[last - 1]].tobytes().decode())
                    first = last - size + 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    return items.mapInArrow(pieces, "item string, text string")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = SIZE,
    block_windows: int = 1_000_000,
    with_text: bool = False,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """``docs`` (any columns with ``text``) plus ``n_words``, ``spans`` (word ranges that are hit)
    and ``items`` (ids, as strings, of the benchmark items found); with ``with_text`` also
    ``clean_text``, the text without the hit spans.

    Columns of ``docs`` that bear these names are replaced.  A null text has no words and is
    returned unhit (``clean_text`` empty); an empty benchmark hits nothing; items that share an id
    are one item, and a null id is written as an empty string.

    A benchmark of more than ``block_windows`` windows or ``block_bytes`` bytes is searched for in
    blocks.  ``docs`` is then read once a block, and must come in the same order each time, as files
    do; what is kept of a block are the rows it hits, without their texts.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_words", "spans", "items", "clean_text")
    items = item_pieces(benchmark, size, min(block_bytes, 1 << 20))
    n_words = F.size(F.split("text", GAPS))
    held = items.agg(F.sum(n_words).alias("windows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-(held["windows"] or 0) // block_windows), -(-(held["bytes"] or 0) // block_bytes))

    def block(number: int) -> list[tuple[str, str]]:
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number)
        return [(r["item"], r["text"]) for r in part.toLocalIterator()]

    if blocks == 1:
        return _pass(docs, block(0), size, with_text)
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    narrow = numbered.select("__row", "text")
    hits = [
        cut(_pass(narrow, block(b), size, False).where(F.size("spans") > 0).select("__row", "spans", "items"))
        for b in range(blocks)
    ]
    found = reduce(DataFrame.unionByName, hits).groupBy("__row").agg(
        _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), TOKEN, "x")
    result = numbered.join(found, "__row", "left").select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.length(F.regexp_replace(letters, "[^x]+", "")).cast("bigint").alias("n_words"),
        F.coalesce("spans", F.array().cast(SPAN_TYPE)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return result.withColumn("clean_text", _cut_words("text", "spans")) if with_text else result


def _cut_words(text: str, spans: str):
    @F.pandas_udf("string")
    def without(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for body, found in zip(texts, ranges):
            raw = np.frombuffer((body or "").encode(), np.uint8)
            starts, ends, _ = word_hashes(raw, np.array([0, len(raw)]))
            cuts = [(int(starts[r["first"]]), int(ends[r["last"] - 1])) for r in found]
            out.append(_without(raw, 0, len(raw), cuts))
        return pd.Series(out, dtype=object)

    return without(F.col(text), F.col(spans))


def hit_words():
    """Words covered by the spans."""
    return F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda total, s: total + s["last"] - s["first"]
    )


def is_contaminated(share: int = 20):
    """At least one word in ``share`` is hit."""
    return (hit_words() > 0) & (hit_words() * share >= F.col("n_words"))


def items_digest():
    """sha256 of the comma-joined ids."""
    return F.sha2(F.array_join("items", ",").cast("binary"), 256)
