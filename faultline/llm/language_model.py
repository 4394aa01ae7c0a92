"""Language model: smoothed n-grams as a weighted backoff automaton, read once from left to right.

A known n-gram of up to ``order`` - 1 words is a state.  Its arcs carry log10 probabilities, and
its failure arc, taken where a word has no arc, leads to the state of the next shorter context
and carries the log10 of the weight that smoothing leaves to it::

    P(w | h) = (c(h w) + strength * P(w | h')) / (c(h) + strength),   h' = h without its first word
    P(w)     = (c(w) + add) / (N + add * (V + 1))

The automaton of a corpus grows with it, so no task and no driver holds it.  Texts are read in
blocks of bounded size.  A block needs the arcs of its own n-grams only: it sends these, sorted
and with their counts in its learned texts, to the shards of the hash range; a shard adds up the
counts of all blocks and answers each block in the order in which it asked.  From the answers a
block builds its part of the automaton, exactly as the whole one would be, and reads its texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import buffers, fresh, set_aside, ship

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GAPS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

MESSAGES = "n int, shard long, block long, words array<binary>, keys binary, counts binary"
ANSWERS = "block long, n int, shard long, totals binary, types long, tokens long"
SCORES = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_known", T.LongType()),
    T.StructField("base_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
]


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers as byte planes: the high ones are nearly all zero and compress away."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their contexts and last words."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The n-grams of some texts.

    A text stands as: border, words, border.  The first border is context only, the last one is
    the end that is counted as a token.  ``grams[k]`` has for each position the number of the
    k-gram that ends there (0 where none does), ``keys[k]`` the sorted keys.  Words are compared
    by their bytes; longer n-grams by keys of 64 bits.
    """

    def __init__(self, column: pa.Array, order: int):
        import xxhash

        raw, offsets = buffers(column)
        solid = ~GAPS[raw]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        bounds = np.concatenate([[0], np.cumsum(end - begin)])
        words = pa.Array.from_buffers(
            pa.large_binary(), len(begin),
            [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(LOWER[raw[solid]])],
        ).dictionary_encode()
        ahead = np.searchsorted(begin, offsets)
        del raw, solid, first, last, begin, end, bounds
        distinct = words.dictionary.to_pylist()
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)
        rank = sorted(range(len(distinct)), key=lambda i: (int(hashes[i]), distinct[i]))
        self.words = [distinct[i] for i in rank]
        place = np.empty(len(rank) + 1, np.int64)
        place[rank] = np.arange(1, len(rank) + 1)
        # number 0 is the border
        self.keys = {1: np.concatenate([[np.uint64(0)], hashes[rank]]).astype(np.uint64)}
        lengths = np.diff(ahead) + 2
        self.starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.lengths = lengths
        size = int(lengths.sum())
        tokens = np.zeros(size, np.int64)
        inside = np.ones(size, bool)
        inside[self.starts] = inside[self.starts + lengths - 1] = False
        tokens[inside] = place[words.indices.to_numpy(zero_copy_only=False)] if len(words) else 0
        self.grams = {1: tokens}
        self.depth = np.arange(size) - np.repeat(self.starts, lengths)
        running = self.keys[1][tokens]
        for k in range(2, order + 1):
            there = np.flatnonzero(self.depth >= k - 1)
            longer = np.zeros(size, np.uint64)
            longer[there] = _mixed(running[there - 1], self.keys[1][tokens[there]])
            self.keys[k], number = np.unique(longer[there], return_inverse=True)
            self.grams[k] = np.zeros(size, np.int64)
            self.grams[k][there] = number
            running = longer

    def counts(self, k: int, learn: np.ndarray) -> np.ndarray:
        """Occurrences of each k-gram in the texts to learn from; the first border is none."""
        taken = np.repeat(learn, self.lengths) & (self.depth >= max(k - 1, 1))
        return np.bincount(self.grams[k][taken], minlength=len(self.keys[k]))


def _shards(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard of each key; grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], size: int):
    """(block id, rows) of one partition: blocks close at ``size`` bytes of text, in row order."""
    number, waiting, weight = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        lengths = np.diff(buffers(batch.column("text"))[1])
        first = 0
        for i, n in enumerate(lengths.tolist()):
            if weight and weight + n > size:
                waiting.append(batch.slice(first, i - first))
                yield number, pa.Table.from_batches(waiting)
                number, waiting, weight, first = number + 1, [], 0, i
            weight += n + 1
        waiting.append(batch.slice(first))
    if weight:
        yield number, pa.Table.from_batches(waiting)


def _ask(batches, order: int, shards: int, size: int) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema(
        [
            ("n", pa.int32()), ("shard", pa.int64()), ("block", pa.int64()),
            ("words", pa.list_(pa.binary())), ("keys", pa.binary()), ("counts", pa.binary()),
        ]
    )
    for number, rows in _blocks(batches, size):
        block = Block(rows.column("text").combine_chunks(), order)
        learn = rows.column("learn").to_numpy()
        words = [b"", *block.words]  # the border goes as an empty word
        for k in range(1, order + 1):
            counts, keys = block.counts(k, learn), block.keys[k]
            if not len(keys):
                continue
            at = _shards(keys, shards)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            out: dict[str, list] = {name: [] for name in kinds.names}
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
                out["n"].append(k)
                out["shard"].append(int(at[i]))
                out["block"].append(number)
                out["words"].append(words[i:j] if k == 1 else None)
                out["keys"].append(None if k == 1 else _planes(np.diff(keys[i:j], prepend=np.uint64(0))))
                out["counts"].append(zlib.compress(_planes(counts[i:j]), 1))
            yield pa.RecordBatch.from_pydict(out, schema=kinds)


def _answer(key, messages):
    """Adds up what the blocks sent to one shard."""
    k = key[0].as_py()
    counts = [_numbers(zlib.decompress(c)) for c in messages.column("counts").to_pylist()]
    ends = np.cumsum([len(c) for c in counts])
    if k == 1:
        words = messages.column("words").combine_chunks().flatten().dictionary_encode()
        number, distinct = words.indices.to_numpy(zero_copy_only=False), len(words.dictionary)
    else:
        sent = [np.cumsum(_numbers(x), dtype=np.uint64) for x in messages.column("keys").to_pylist()]
        names, number = np.unique(np.concatenate(sent), return_inverse=True)
        distinct = len(names)
    totals = np.zeros(distinct, np.int64)
    np.add.at(totals, number, np.concatenate(counts).astype(np.int64))
    replies = [zlib.compress(_planes(x), 1) for x in np.split(totals[number], ends[:-1])]
    n = len(replies)
    return pa.table(
        {
            "block": messages.column("block"),
            "n": pa.array([k] * n, pa.int32()),
            "shard": pa.array([key[1].as_py()] * n, pa.int64()),
            "totals": pa.array(replies, pa.binary()),
            "types": pa.array([int((totals > 0).sum())] + [0] * (n - 1), pa.int64()),
            "tokens": pa.array([int(totals.sum())] + [0] * (n - 1), pa.int64()),
        }
    )


class Automaton:
    """The part of the backoff automaton that a block of texts can reach.

    A state is the n-gram it stands for: on position ``p`` of a text, depth ``k`` names the k-gram
    that ends there.  ``arc[k]`` weighs the arcs whose context and word make up a k-gram,
    ``fail[k]`` the failure arcs of states of depth k, ``seen[k]`` tells which k-grams exist.
    """

    def __init__(self, block: Block, totals: dict[int, np.ndarray], tokens: int, types: int,
                 order: int, strength: float, add: float):
        self.block, self.order = block, order
        one = np.log10((totals[1] + add) / (tokens + add * (types + 1)))
        self.arc, self.fail = {1: one}, {}
        self.seen = {k: totals[k] > 0 for k in totals}
        below = 10.0 ** one[block.grams[1]]
        for k in range(2, order + 1):
            here = np.zeros(len(block.keys[k]), np.int64)
            there = np.flatnonzero(block.depth >= k - 1)
            here[block.grams[k][there]] = there  # any occurrence of each n-gram
            context = totals[k - 1][block.grams[k - 1][here - 1]]
            found = (totals[k] + strength * below[here]) / (context + strength)
            self.arc[k] = np.log10(found)
            self.fail[k - 1] = np.log10(strength / (totals[k - 1] + strength))
            whole = below.copy()
            whole[there] = found[block.grams[k][there]]
            below = whole

    def scores(self) -> np.ndarray:
        """One traversal of each text, all texts in step; a text drops out at its end."""
        block, order = self.block, self.order
        rank = np.argsort(-block.lengths, kind="stable")
        start, lengths = block.starts[rank], block.lengths[rank]
        total = np.zeros(len(rank))
        state = np.where(self.seen[1][block.grams[1][start]], min(1, order - 1), 0)
        still = np.searchsorted(-lengths, -np.arange(1, int(lengths.max(initial=0)) + 1), "right")
        for step in range(1, int(lengths.max(initial=0))):
            n = int(still[step])
            at = start[:n] + step
            depth, got, moved = state[:n], np.zeros(n), np.full(n, -1)
            for k in range(order - 1, 0, -1):
                gram = block.grams[k + 1][at]
                in_k = (depth == k) & (moved < 0)
                has = in_k & self.seen[k + 1][gram]
                got += np.where(has, self.arc[k + 1][gram], 0.0)
                moved = np.where(has, min(k + 1, order - 1), moved)
                falls = in_k & ~has
                got += np.where(falls, self.fail[k][block.grams[k][at - 1]], 0.0)
                depth = np.where(falls, k - 1, depth)
            word = block.grams[1][at]
            rest = moved < 0
            got += np.where(rest, self.arc[1][word], 0.0)
            reached = np.where(self.seen[1][word], min(1, order - 1), 0)
            state[:n] = np.where(rest, reached, moved)
            total[:n] += got
        out = np.empty(len(rank))
        out[rank] = total
        return out


def _read(rows: pa.Table, answers: pa.Table, order: int, tokens: int, types: int,
          strength: float, add: float, schema: pa.Schema) -> pa.Table:
    block = Block(rows.column("text").combine_chunks(), order)
    rank = np.argsort(answers.column("shard").to_numpy(), kind="stable")
    ns, sent = answers.column("n").to_numpy(), answers.column("totals")
    totals = {}
    for k in range(1, order + 1):
        parts = [_numbers(zlib.decompress(sent[int(i)].as_py())) for i in rank if ns[i] == k]
        totals[k] = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        if len(totals[k]) != len(block.keys[k]):
            raise ValueError("the texts were read in another order than before; write them first")
    automaton = Automaton(block, totals, tokens, types, order, strength, add)
    counted = block.depth > 0
    known = np.add.reduceat((counted & automaton.seen[1][block.grams[1]]).astype(np.int64), block.starts)
    base = np.add.reduceat(np.where(counted, automaton.arc[1][block.grams[1]], 0.0), block.starts)
    made = [block.lengths - 1, known, base, automaton.scores()]
    columns = [rows.column(name) for name in schema.names[: -len(made)]]
    return pa.Table.from_arrays([*columns, *map(pa.array, made)], schema=schema)


def with_scores(
    docs: DataFrame, learn: Column, order: int = 2, strength: float = 300.0, add: float = 0.1,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known`` (tokens that occur in the learned texts),
    ``train_tokens``, ``base_score`` (by single words) and ``score`` in place of ``text``; columns
    of these names are replaced.

    Where ``learn`` is true, a row is learned from; null counts as false.  A null text is empty:
    its one token is the end.  Without rows to learn from every token has probability 1.  Repeated
    rows count each.  A text is read whole; a block has ``block_bytes`` of text or one text.

    ``docs`` is read twice and must come in the same order both times, as files do; rows from a
    shuffle should be written before (another order is noticed and fails).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    ship(spark)
    added = [f.name for f in SCORES] + ["train_tokens"]
    docs = docs.drop(*added).withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    plain, _ = set_aside(docs, "learn", "block")
    flagged = docs.select(
        *[F.col(f"`{old}`").alias(new) for old, new in zip(docs.columns, plain.columns)],
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    total = flagged.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    shards = total // block_bytes + 1

    asked = flagged.select("text", "learn").mapInArrow(
        partial(_ask, order=order, shards=shards, size=block_bytes), MESSAGES
    )
    folder = fresh(spark, "answers")
    asked.groupBy("n", "shard").applyInArrow(_answer, ANSWERS).write.parquet(folder)
    answers = spark.read.parquet(folder)
    known = answers.where("n = 1").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    tokens, types = known["tokens"] or 0, known["types"] or 0

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _blocks(batches, block_bytes):
            marked = rows.append_column("block", pa.array(np.full(len(rows), number), pa.int64()))
            yield from marked.to_batches()

    placed = plain.mapInArrow(numbered, T.StructType([*plain.schema.fields, T.StructField("block", T.LongType())]))
    schema = T.StructType([*[f for f in plain.schema.fields if f.name != "text"], *SCORES])
    arrow = to_arrow_schema(schema)

    def score(rows, sent):
        return _read(rows, sent, order, tokens, types, strength, add, arrow)

    scored = (
        placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
    )
    names = {c: p for c, p in zip(docs.columns, plain.columns) if c != "text"}
    return scored.select(
        *[F.col(f"`{p}`").alias(c) for c, p in names.items()],
        "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
