"""Prefix trie of conversations, from padded matrices of turn ids.

A conversation is a sequence of turn ids (MD5 of role and text).  Equal sequences fold, the
distinct ones are dealt by range, so a common prefix is many tasks.  A task cuts its rows into
tiles of bounded size.  In a tile, the ids are a padded integer matrix: ``lexsort`` orders the
rows, the change masks of the columns, OR-accumulated from the left, mark where nodes start, and
``reduceat`` sums up each depth.  Every figure of a node is a sum or a minimum over the rows
below it, so a node that crosses tiles or ranges is recombined by one aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import cut, ship

#: Hexadecimal digits of a turn id.
ID = 32
#: Members are gathered by 1,024 neighbouring ids: a sequence that a third of all conversations
#: share comes as few rows.
BLOCK_BITS = 10
#: A parent whose children lie in many tasks is looked up in so many slices.
SLICES = 32

NODE_SCHEMA = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, key string, parent_key string"
)
NODE = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame, family: int = 1) -> DataFrame:
    """``family`` (``conv_id`` less its remainder), ``conv_id`` and ``turns``, a list of
    (turn, id, size): the turns in order, a null turn first, equal turn numbers by their id.

    A null role or text is empty.  Rows without a conv_id belong to no conversation and are left
    out.  Repeated rows are turns of their own.  Texts are not gathered, only 16 bytes and a size
    of each; families lie in one partition.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"),
        F.octet_length(text).cast("bigint").alias("size"),
    )
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.col("conv_id") % family).cast("bigint").alias("family"),
        F.col("conv_id").cast("bigint").alias("conv_id"),
        turn.alias("turn"),
    )
    return (
        rows.repartition("family")
        .groupBy("family", "conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    )


def with_family_start(lists: DataFrame, span: int) -> DataFrame:
    """Puts the first h turns of the conversation that heads the family in place of the first h
    turns of each; h is the CRC-32 of the conv_id as text, modulo ``span``."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(span)).cast("int")
    head = F.max(
        F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, span - 1))
    ).over(Window.partitionBy("family"))
    own = F.slice("turns", h + 1, F.size("turns"))
    started = F.when(head.isNull(), own).otherwise(F.concat(F.slice(head, F.lit(1), h), own))
    return lists.withColumn("turns", started)


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their start."""
    n = min(len(a), len(b)) // ID
    if a[: n * ID] == b[: n * ID]:
        return n
    left, right = (np.frombuffer(x[: n * ID], f"S{ID}") for x in (a, b))
    return int(np.argmax(left != right))


def _keys(path: bytes, depth: int) -> list[str]:
    """Names of the nodes of depth 0 to ``depth`` on a path."""
    digest, keys = hashlib.sha256(), []
    keys.append(digest.hexdigest())
    for d in range(depth):
        digest.update(path[d * ID : (d + 1) * ID])
        keys.append(digest.copy().hexdigest())
    return keys


def tile_nodes(paths, sizes, members, lowest, ends, before: int, after: int) -> dict[str, list]:
    """The nodes of a tile of distinct sequences in byte order.

    ``before`` and ``after`` are the turns that its first and last sequence share with their
    neighbours outside (-1: there is none).  Nodes that go on there get a ``key``, nodes below
    them a ``parent_key``.
    """
    lengths = np.array([len(p) // ID for p in paths])
    wide = int(lengths.max()) + 1
    turns = b"".join(paths)
    codes = np.unique(np.frombuffer(turns, f"S{ID}"), return_inverse=True)[1] if turns else np.zeros(0, int)
    held = np.arange(wide) <= lengths[:, None]
    held[:, 0] = True
    ids = np.full((len(paths), wide), -1, np.int64)
    weight = np.zeros((len(paths), wide), np.int64)
    below = held.copy()
    below[:, 0] = False
    ids[:, 0] = 0  # the root
    ids[below] = codes
    weight[below] = np.concatenate([np.asarray(s, np.int64) for s in sizes]) if codes.size else 0
    order = np.lexsort(ids.T[::-1])
    ids, weight, held, lengths = ids[order], weight[order], held[order], lengths[order]
    members, lowest = np.asarray(members)[order], np.asarray(lowest)[order]
    paths, ends = [paths[i] for i in order], [ends[i] for i in order]

    change = np.ones(ids.shape, bool)
    change[1:] = ids[1:] != ids[:-1]
    change = np.logical_or.accumulate(change, axis=1)
    started = change & held
    started[0, : before + 1] = False
    shared = np.where(change[1:].any(1), np.argmax(change[1:], 1), wide) - 1
    leaf = np.append(shared, after) < lengths  # the next sequence does not go on from this one
    # saved: every turn of every member, less each node's own turn once
    spent = (members[:, None] - started) * weight
    spent = np.cumsum(spent[:, ::-1], axis=1)[:, ::-1]

    first_keys, last_keys = _keys(paths[0], max(before, 0)), _keys(paths[-1], max(after, 0))
    out: dict[str, list] = {name: [] for name in [*NODE, "key", "parent_key"]}
    over = over_low = over_keys = None
    for depth in range(wide):
        starts = np.flatnonzero(change[:, depth])
        low = np.minimum.reduceat(lowest, starts)
        children = started[:, depth + 1] if depth + 1 < wide else np.zeros(len(paths), bool)
        real = held[starts, depth]
        keys = np.full(len(starts), None, object)
        if depth <= before:
            keys[0] = first_keys[depth]
        if depth <= after:
            keys[-1] = last_keys[depth]
        parents = np.full(len(starts), None, object)
        parent_keys = np.full(len(starts), None, object)
        if over is not None:
            above = np.searchsorted(over, starts, "right") - 1
            parents[:] = over_low[above].tolist()
            parent_keys = over_keys[above]
        out["conv_id"].extend(low[real].tolist())
        out["depth"].extend([depth] * int(real.sum()))
        out["parent_conv_id"].extend(parents[real])
        for name, values in (
            ("n_convs", members), ("n_children", children.astype(np.int64)),
            ("n_leaves", leaf.astype(np.int64)), ("saved_tokens", spent[:, depth]),
        ):
            out[name].extend(np.add.reduceat(values, starts)[real].tolist())
        out["ends_sha256"].extend(ends[s] if lengths[s] == depth else None for s in starts[real])
        out["key"].extend(keys[real])
        out["parent_key"].extend(parent_keys[real])
        over, over_low, over_keys = starts, low, keys
    return out


def _folded(batches: Iterator[pa.RecordBatch]):
    """(path, sizes, members, smallest member, digest of members) of each distinct sequence: its
    rows come one after the other, by block, and only one row's ids are held."""
    path = None
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("path", "sizes", "n", "low", "ids")]
        for p, s, n, low, ids in zip(*columns):
            if p != path:
                if path is not None:
                    yield path.encode(), size, members, lowest, digest.hexdigest()
                path, size, members, lowest, digest = p, s, 0, low, hashlib.sha256()
            else:
                digest.update(b",")
            members += n
            lowest = min(lowest, low)
            digest.update(ids.encode())
    if path is not None:
        yield path.encode(), size, members, lowest, digest.hexdigest()


def prefix_trie(sequences: DataFrame, cells: int = 1 << 20) -> DataFrame:
    """Nodes of the trie of ``sequences`` (``conv_id``, ``turns`` as in :func:`turn_lists`).

    Per node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id`` (null for the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.  No
    sequences give no nodes, not even a root; a sequence without turns is a member of the root.
    Only one sequence has to fit a task whole; a tile has at most ``cells`` cells, or one row.
    """
    spark = sequences.sparkSession
    ship(spark)
    rows = sequences.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["id"]), "").alias("path"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )
    bundles = rows.groupBy("path", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(
        F.first("sizes").alias("sizes"),
        F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("low"),
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"),
    )
    placed = cut(
        cut(bundles).repartitionByRange("path").sortWithinPartitions("path", "block")
    )
    # what a range shares with its neighbours: two sequences a range, as numbers
    edges = (
        placed.groupBy(F.spark_partition_id().alias("range"))
        .agg(F.min("path").alias("first"), F.max("path").alias("last"))
        .orderBy("range")
        .collect()
    )
    meet = [-1, *(_common(a["last"].encode(), b["first"].encode()) for a, b in zip(edges, edges[1:])), -1]
    sides = {e["range"]: (meet[i], meet[i + 1]) for i, e in enumerate(edges)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = sides.get(TaskContext.get().partitionId(), (-1, -1))
        tile: list[tuple] = []
        wide = 0

        def made(after: int) -> pa.RecordBatch:
            found = tile_nodes(*map(list, zip(*tile)), before, after)
            kinds = [pa.int64()] * 7 + [pa.string()] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(found.values(), kinds)], names=list(found)
            )

        for row in _folded(batches):
            longest = max(wide, len(row[0]) // ID + 1)
            if tile and longest * (len(tile) + 1) > cells:
                shared = _common(tile[-1][0], row[0])
                yield made(shared)
                tile, before, longest = [], shared, len(row[0]) // ID + 1
            tile.append(row)
            wide = longest
        if tile:
            yield made(last)

    nodes = cut(placed.mapInArrow(run, NODE_SCHEMA))
    crossing = (
        nodes.where(F.col("key").isNotNull())
        .groupBy("key", "depth")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.lit(None).cast("bigint").alias("parent_conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("ends_sha256").alias("ends_sha256"),
            F.max("parent_key").alias("parent_key"),
        )
    )
    # every row of a crossing parent's children asks for its smallest member; a parent may have
    # very many children, so it stands in slices
    parents = crossing.select(
        F.col("key").alias("parent_key"),
        F.col("conv_id").alias("__parent"),
        F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("__slice"),
    )
    whole = nodes.where(F.col("key").isNull())
    asking = whole.where(F.col("parent_key").isNotNull()).unionByName(
        crossing.where(F.col("parent_key").isNotNull())
    )
    answered = (
        asking.withColumn("__slice", F.pmod(F.xxhash64("conv_id", "n_convs"), F.lit(SLICES)).cast("int"))
        .join(parents, ["parent_key", "__slice"])
        .withColumn("parent_conv_id", F.col("__parent"))
    )
    settled = whole.where(F.col("parent_key").isNull()).unionByName(
        crossing.where(F.col("parent_key").isNull())
    )
    return (
        settled.select(NODE)
        .unionByName(answered.select(NODE))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    )
