"""Sharding by Karmarkar-Karp differencing: near-equal bytes for indivisible groups.

Rows of equal text are one group.  A group that weighs more than one part in ``items`` of all
bytes enters by itself; lighter ones enter in bundles by a hash, at most ``items`` of them.  So
the differencing works on at most ``2 * items`` numbers, whatever the input, and a heavy group
still has light bundles to be offset with.  Each number starts as a partial partition (itself in
one part, nothing in the others); the two partial partitions of largest spread are combined in
opposite order until one is left.  Sizes and hashes move between tasks; texts don't.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import cut, text_or_empty


def differencing(partials: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Combines partial partitions (equally long arrays of sums).

    Returns the sums of the final partition, and for each partial the final part that each of its
    parts became.  Ties go by position, so that a rerun agrees.
    """
    width = len(partials[0])
    heap, trees, count = [], [], 0
    for i, sums in enumerate(partials):
        order = np.argsort(-sums, kind="stable")
        heap.append((int(sums.min() - sums.max()), count, sums[order], i))
        trees.append((order, None, None))
        count += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, first, a = heapq.heappop(heap)
        _, _, second, b = heapq.heappop(heap)
        both = first + second[::-1]
        order = np.argsort(-both, kind="stable")
        trees.append((order, a, b))
        sums = both[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), count, sums, len(trees) - 1))
        count += 1
    _, _, sums, root = heap[0]
    final: list[np.ndarray] = [np.zeros(0, np.int64)] * len(partials)
    stack = [(root, np.arange(width))]
    while stack:
        node, becomes = stack.pop()
        order, a, b = trees[node]
        back = np.empty(width, np.int64)
        back[order] = becomes  # part before sorting -> final part
        if a is None:
            final[node] = back
        else:
            stack.append((a, back))
            stack.append((b, back[::-1]))
    return sums, final


def _deal(sizes: list[int], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of single groups, and the sums of the parts."""
    partials = []
    for size in sizes:
        alone = np.zeros(shards, np.int64)
        alone[0] = size
        partials.append(alone)
    sums, final = differencing(partials)
    return np.array([places[0] for places in final]), sums


def group_shards(groups: DataFrame, shards: int = 16, items: int = 16_384) -> DataFrame:
    """``shard`` for groups with a unique ``grp`` (hex text) and a ``bytes`` column."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = F.col("bytes").cast("decimal(20,0)") * items > F.lit(total).cast("decimal(28,0)")
    bundle = F.pmod(F.xxhash64("grp"), F.lit(items)).cast("string")
    named = groups.select("grp", "bytes", F.when(heavy, F.col("grp")).otherwise(bundle).alias("item"))
    # 2 * items rows at most
    weights = named.groupBy("item").agg(F.sum("bytes").alias("bytes")).toPandas()
    weights = weights.sort_values(["bytes", "item"], ascending=[False, True], kind="stable")
    parts = _deal(weights["bytes"].tolist(), shards)[0] if len(weights) else []
    places = groups.sparkSession.createDataFrame(
        pd.DataFrame({"item": weights["item"].astype(object), "shard": np.array(parts, np.int32)}),
        "item string, shard int",
    )
    return named.join(F.broadcast(places), "item").select("grp", "shard")


def with_slots(rows: DataFrame, order: list[Column], blocks: int = 1024) -> DataFrame:
    """Adds ``slot``: positions from 0 without gaps in each shard, along ``order``.

    Rows are numbered within blocks of a shard by a hash of the order; counts per block give
    where a block begins, so no task orders a whole shard.
    """
    marked = rows.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = marked.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("shard").orderBy("__block")
    begins = counts.select(
        "shard", "__block", (F.sum("__n").over(earlier) - F.col("__n")).alias("__begin")
    )
    within = Window.partitionBy("shard", "__block").orderBy(*order)
    numbered = marked.withColumn("__at", F.row_number().over(within) - 1)
    return (
        numbered.join(F.broadcast(begins), ["shard", "__block"])
        .withColumn("slot", F.col("__begin") + F.col("__at"))
        .drop("__block", "__begin", "__at")
    )


def byte_shards(docs: DataFrame, shards: int = 16, items: int = 16_384) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard`` and ``slot``.

    A null text is empty and shares a group with other empty texts.  Rows with equal text always
    share a shard, also repeated rows and rows without an id; those are told apart by where they
    were read.  An empty table gives no rows.
    """
    placed = _placed(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row")), shards, items)
    return placed.drop("__row")


def with_shards(docs: DataFrame, shards: int = 16, items: int = 16_384) -> DataFrame:
    """``docs`` plus ``size``, ``text_crc32``, ``shard`` and ``slot`` as in :func:`byte_shards`; columns
    of these names are replaced.  ``docs`` is read twice and must come in the same order both
    times, as files do."""
    made = ["size", "text_crc32", "shard", "slot"]
    numbered = docs.drop(*made).withColumn("__row", F.monotonically_increasing_id())
    placed = _placed(numbered.select("doc_id", "text", "__row"), shards, items)
    return numbered.join(placed.select("__row", *made), "__row").drop("__row")


def _placed(rows: DataFrame, shards: int, items: int) -> DataFrame:
    body = text_or_empty().cast("binary")
    narrow = cut(
        rows.select(
            "__row",
            "doc_id",
            (F.octet_length(body) + 1).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.sha2(body, 256).alias("grp"),
        )
    )
    groups = cut(narrow.groupBy("grp").agg(F.sum("size").alias("bytes")))
    placed = narrow.join(group_shards(groups, shards, items), "grp")
    return with_slots(placed, [F.col("doc_id"), F.col("grp"), F.col("__row")]).drop("grp")
