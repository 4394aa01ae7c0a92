"""SimHash near-duplicates: fingerprints, BK-trees by shard, and connected components.

Two 64-bit fingerprints within three bits agree in one of four 16-bit blocks.  So a shard is one
value of one block; every distinct fingerprint belongs to four shards, and the tree of a shard is
searched with that shard's members only.  A shard with more than ``shard_size`` members is dealt
anew by four blocks of its other 48 bits, and what is still larger is cut into tree slices that
all members of the shard search.  A shard sends on one link per member to the smallest member it
is connected with, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.bktree import Forest, merged
from faultline.llm.common import cut, set_aside, ship
from faultline.llm.components import components

SEED = 42
BITS = 64
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of XXH64 over the word shingles; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first : first + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` plus ``print``: the fingerprint as a signed 64-bit number."""
    ship(docs.sparkSession)
    docs = docs.drop("print")
    schema = T.StructType([*docs.schema.fields, T.StructField("print", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter(
                (fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made.view(np.int64))], names=schema.names
            )

    return docs.mapInArrow(run, schema)


def _widths(bits: int, parts: int) -> list[int]:
    return [bits // parts] * (parts - 1) + [bits - bits // parts * (parts - 1)]


def _field(value: Column, first: int, width: int) -> Column:
    """The bits ``first`` to ``first + width`` of a 64-bit number."""
    moved = F.shiftrightunsigned(value, first) if first else value
    return moved.bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _blocks(value: Column, bits: int, radius: int) -> list[Column]:
    """Blocks of which two numbers within the radius share at least one, as (block, value)."""
    widths = _widths(bits, radius + 1)
    return [
        F.struct(F.lit(i).alias("block"), _field(value, sum(widths[:i]), w).alias("value"))
        for i, w in enumerate(widths)
    ]


def _shards(prints: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint once per block: ``block`` and ``value`` name the shard."""
    return prints.select("print", F.inline(F.array(*_blocks(F.col("print"), BITS, radius))))


def _finer(radius: int) -> Column:
    """Shards of a crowded shard's member, by blocks of the bits outside the shard's own block."""
    widths = _widths(BITS, radius + 1)
    choice = None
    for i, width in enumerate(widths):
        first = sum(widths[:i])
        after = first + width
        low = _field(F.col("print"), 0, first) if first else F.lit(0).cast("bigint")
        high = F.shiftleft(F.shiftrightunsigned("print", after), first) if after < BITS else F.lit(0)
        shards = F.array(
            *[
                F.xxhash64("block", "value", inner["block"], inner["value"])
                for inner in _blocks(low.bitwiseOR(high), BITS - width, radius)
            ]
        )
        here = F.col("block") == i
        choice = F.when(here, shards) if choice is None else choice.when(here, shards)
    return choice


def _links_of(radius: int):
    """Links of complete shards in a stream of rows sorted by shard and slice.

    ``slice`` is the tree slice a row searches, ``own`` says whether it is also a node of it.
    """

    def flush(shard: np.ndarray, piece: np.ndarray, prints: np.ndarray, own: np.ndarray):
        change = np.ones(len(shard), bool)
        change[1:] = (shard[1:] != shard[:-1]) | (piece[1:] != piece[:-1])
        group = np.cumsum(change) - 1
        inside = np.flatnonzero(own)
        forest = Forest(group[inside], prints[inside])
        root_of = np.full(group[-1] + 1, -1)
        root_of[group[inside]] = forest.root
        asks = np.flatnonzero(root_of[group] >= 0)
        labels = np.arange(len(prints))
        for query, node in forest.search(prints[asks], root_of[group[asks]], radius):
            a, b = asks[query], inside[node]
            different = a != b
            if different.any():
                labels = merged(labels, a[different], b[different])
        moved = np.flatnonzero(labels != np.arange(len(prints)))
        if len(moved):
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints[moved].view(np.int64)), pa.array(prints[labels[moved]].view(np.int64))],
                names=["a", "b"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "slice", "print", "own")]
            if kept is not None:
                now = [np.concatenate(pair) for pair in zip(kept, now)]
            change = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            last = int(change[-1]) if len(change) else 0
            if last:
                yield from flush(*_ready([x[:last] for x in now]))
            kept = [x[last:] for x in now]
        if kept is not None and len(kept[0]):
            yield from flush(*_ready(kept))

    def _ready(parts):
        shard, piece, prints, own = parts
        return shard, piece, prints.astype(np.int64).view(np.uint64), own.astype(bool)

    return run


def links(prints: DataFrame, radius: int = 3, shard_size: int = 4096) -> DataFrame:
    """Links between distinct fingerprints (column ``print``) that connect all pairs in the radius."""
    dealt = _shards(prints, radius)
    # one row per block value: 4 * 2**16 for a radius of 3, whatever the input
    crowded = F.broadcast(
        dealt.groupBy("block", "value")
        .agg((F.count("*") > shard_size).alias("crowded"))
        .where("crowded")
    )
    plain = F.array(F.xxhash64("block", "value"))
    placed = dealt.join(crowded, ["block", "value"], "left").select(
        "print",
        F.coalesce("crowded", F.lit(False)).alias("finer"),
        F.explode(F.when(F.col("crowded"), _finer(radius)).otherwise(plain)).alias("shard"),
    )
    still = (
        placed.where("finer")
        .groupBy("shard")
        .agg(F.ceil(F.count("*") / shard_size).cast("int").alias("pieces"))
        .where("pieces > 1")
    )
    members = (
        placed.join(still, "shard", "left")
        .withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        .select(
            "shard",
            F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("slice"),
            "print",
            F.pmod(F.xxhash64("print"), F.col("pieces")).alias("home"),
        )
        .select("shard", "slice", "print", (F.col("slice") == F.col("home")).alias("own"))
    )
    return (
        members.repartition("shard", "slice")
        .sortWithinPartitions("shard", "slice")
        .mapInArrow(_links_of(radius), "a bigint, b bigint")
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, shard_size: int = 4096) -> DataFrame:
    """``doc_id``, ``print``, ``component_print`` and ``component_id`` of every row of ``docs``.

    Texts of null and texts without words have fingerprint zero and link like any other.  Rows
    that repeat an id stay rows of their own.  ``component_id`` is the smallest id in the
    component; ids of null are passed over, and it is null where all are.
    """
    narrow = cut(with_fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "print"))
    distinct = narrow.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    joined = components(links(distinct.select("print"), radius, shard_size))
    joined = cut(joined)
    of_root = (
        joined.join(distinct, joined["node"] == distinct["print"])
        .groupBy("root")
        .agg(F.min("first_id").alias("root_id"))
    )
    places = joined.join(of_root, "root").select(F.col("node").alias("print"), "root", "root_id")
    mapped = distinct.join(places, "print", "left").select(
        "print",
        F.coalesce("root", "print").alias("component_print"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("root_id")).alias("component_id"),
    )
    return narrow.join(mapped, "print", "left").select(
        "doc_id", "print", "component_print", "component_id"
    )


def one_per_component(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row per component: the one with the smallest id (and of equal rows, one)."""
    found = near_duplicates(docs, shingle, radius)
    chosen = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component_print")
        .agg(F.min(F.struct("doc_id", "print")).alias("best"))
        .select(F.col("best.doc_id").alias("__id"), F.col("best.print").alias("__print"))
    )
    plain, back = set_aside(docs, "print", "__id", "__print")
    rows = with_fingerprints(plain, shingle)
    survivors = rows.join(
        chosen,
        rows["print"].eqNullSafe(chosen["__print"]) & rows["doc_id"].eqNullSafe(chosen["__id"]),
        "left_semi",
    ).dropDuplicates(["print", "doc_id"])
    return back(survivors)


def hex_print(column: str = "print"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
