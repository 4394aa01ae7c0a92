"""Exact nearest vectors through pivots.

The index stores each chunk with its nearest of a few hundred pivots and the distance to it.  A cell
is a slice of the chunks of one pivot, of bounded size.  For a query, the triangle inequality says
how near a chunk of a cell can be at best, from the distance between query and pivot.  So a query
first asks the cells around it, until they hold ``k`` chunks, and then only those cells that can
hold a nearer one than the ``k``-th found.  Queries and cells meet in the tasks, as groups by cell;
only the pivots and one line of figures per cell pass through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.ordered import first_rows
from faultline.session import checkpointed

#: Rounding of distances is far below this share of them.
SLACK = 1e-9


@dataclass
class PivotIndex:
    """``chunks`` holds ``chunk_id, case_id, embedding, pivot, slice, radius``; ``pivots`` are vectors."""

    chunks: DataFrame
    pivots: list[list[float]]

    def cells(self) -> DataFrame:
        """Per cell: its number of chunks and the range of their distances to the pivot."""
        return self.chunks.groupBy("pivot", "slice").agg(
            F.count(F.lit(1)).alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most")
        )


def _nearest_pivot(pivots: list[list[float]]):
    """A function that adds the nearest pivot and the distance to it, batch after batch."""

    def place(batches):
        import numpy as np
        import pyarrow as pa

        points = np.array(pivots, dtype="float64")
        for batch in batches:
            vectors = [np.asarray(v, dtype="float64") for v in batch.column("embedding").to_pylist()]
            for v in vectors:
                if len(v) != points.shape[1]:
                    raise ValueError(f"a vector of {len(v)} values among vectors of {points.shape[1]}")
            names, radii = [], []
            for start in range(0, len(vectors), 1024):
                rows = np.stack(vectors[start : start + 1024])
                about = np.square(rows).sum(1)[:, None] - 2 * rows @ points.T + np.square(points).sum(1)
                best = about.argmin(1)
                names += best.tolist()
                radii += np.sqrt(np.square(rows - points[best]).sum(1)).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.int32()), pa.array(radii, pa.float64())],
                names=[*batch.schema.names, "pivot", "radius"],
            )

    return place


def build_index(chunks: DataFrame, path: str, pivots: int = 256, slice_rows: int = 20_000) -> PivotIndex:
    """Writes the index of ``chunks`` (``chunk_id, embedding`` and maybe ``incident_id``) to ``path``.

    The pivots are the vectors that come first by a hash of the chunk id: any would give the
    same hits.  Chunks without a vector are left out.  A pivot with many chunks has several cells, cut
    by distance, so a vector that a third of all chunks share is many tasks.
    """
    spark = chunks.sparkSession
    owner = F.col("incident_id") if "incident_id" in chunks.columns else F.lit(None)
    stored = chunks.where(F.col("embedding").isNotNull()).select(
        "chunk_id", owner.cast("string").alias("case_id"), "embedding"
    )
    chosen = stored.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots)
    points = [[float(x) for x in r["embedding"]] for r in chosen.collect()]
    lengths = sorted({len(p) for p in points})
    if len(lengths) > 1:
        raise ValueError(f"a vector of {lengths[0]} values among vectors of {lengths[-1]}")
    schema = f"chunk_id {dict(stored.dtypes)['chunk_id']}, case_id string, embedding {dict(stored.dtypes)['embedding']}"
    placed = stored.mapInArrow(_nearest_pivot(points or [[]]), f"{schema}, pivot int, radius double")
    placed.write.mode("overwrite").parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    # limits between the slices of a pivot: quantiles of the distances, equal ones dealt by hash
    spread = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).select(
        "pivot", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices")
    )
    most = spread.agg(F.max("slices")).first()[0] or 1
    if most > 1:
        cuts = placed.join(spread, "pivot").groupBy("pivot", "slices").agg(
            F.percentile_approx("radius", [i / most for i in range(1, most)], 1000).alias("cuts")
        )
        rank = F.size(F.filter("cuts", lambda c: F.col("radius") > c)) + F.size(
            F.filter("cuts", lambda c: F.col("radius") == c)
        ) * F.pmod(F.xxhash64("chunk_id"), F.lit(1000)) / 1000
        slice_no = F.floor(rank * F.col("slices") / most).cast("int")
        placed = placed.join(cuts, "pivot").withColumn("slice", slice_no).drop("cuts", "slices")
    else:
        placed = placed.withColumn("slice", F.lit(0))
    placed.repartition("pivot", "slice").write.mode("overwrite").partitionBy("pivot").parquet(f"{path}/index")
    numbered = spark.createDataFrame(list(enumerate(points)), "pivot int, point array<double>")
    numbered.write.mode("overwrite").parquet(f"{path}/pivots")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> PivotIndex:
    """An index that has been written."""
    schema = spark.read.parquet(f"{path}/placed").schema.add("slice", T.IntegerType())
    pivots = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()
    return PivotIndex(spark.read.schema(schema).parquet(f"{path}/index"), [list(r["point"]) for r in pivots])


def _bounds(pivots: list, cells: list, k: int):
    """Per query and cell: the least possible distance, and whether the cell is asked first."""

    def bound(batches):
        import numpy as np
        import pyarrow as pa

        points = np.array(pivots, dtype="float64")
        of, slices, n, least, most = (np.array(c) for c in zip(*cells))
        for batch in batches:
            ids = batch.column("query_id")
            vectors = batch.column("embedding").to_pylist()
            out = []
            for place, vector in enumerate(vectors):
                vector = np.asarray(vector, dtype="float64")
                if len(vector) != points.shape[1]:
                    raise ValueError(f"a query of {len(vector)} values for vectors of {points.shape[1]}")
                away = np.sqrt(np.square(points - vector).sum(1))[of]
                lower = np.maximum(np.maximum(away - most, least - away), 0.0)
                order = np.lexsort((away, lower))
                first = np.zeros(len(cells), bool)
                first[order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]] = True
                out.append((place, lower, first, away))
            rows = np.repeat([o[0] for o in out], len(cells)).astype(np.int64)
            many = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows)), batch.column("embedding").take(pa.array(rows)),
                    pa.array(np.tile(of, len(out)).astype(np.int32)), pa.array(np.tile(slices, len(out)).astype(np.int32)),
                    pa.array(many[0].astype(float)), pa.array(many[1].astype(bool)), pa.array(many[2].astype(float)),
                ],
                names=["query_id", "embedding", "pivot", "slice", "lower", "first", "away"],
            )

    return bound


def _cell_search(k: int, slack: float):
    """Nearest chunks of one cell to the queries that ask it, and how many distances that took."""

    def search(asked, chunks):
        import numpy as np
        import pyarrow as pa

        names = ["query_id", "chunk_id", "case_id", "distance", "computed"]
        kinds = [asked.schema.field("query_id").type, chunks.schema.field("chunk_id").type, pa.string(), pa.float64(), pa.int64()]
        found = [[] for _ in names]
        if len(asked) and len(chunks):
            rows = np.stack([np.asarray(v, "float64") for v in chunks.column("embedding").to_pylist()])
            radius = chunks.column("radius").to_numpy()
            ids = chunks.column("chunk_id").to_pylist()
            owners = chunks.column("case_id").to_pylist()
            rank = np.empty(len(ids), np.int64)
            rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
            for name, vector, away, limit in zip(
                *(asked.column(c).to_pylist() for c in ("query_id", "embedding", "away", "limit"))
            ):
                near = np.arange(len(rows))
                if limit is not None:  # chunks, too, are skipped by their distance to the pivot
                    near = np.flatnonzero(np.abs(away - radius) <= limit * (1 + slack) + slack)
                distance = np.square(rows[near] - np.asarray(vector, "float64")).sum(axis=1)
                best = np.lexsort((rank[near], distance))[:k]
                for i, j in enumerate(best.tolist()):
                    at = int(near[j])
                    values = (name, ids[at], owners[at], float(distance[j]), len(near) if i == 0 else 0)
                    for column, value in zip(found, values):
                        column.append(value)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], names=names)

    return search


def nearest_by_pivots(queries: DataFrame, index: PivotIndex, k: int, counted: bool = False) -> DataFrame:
    """The ``k`` nearest chunks per query by squared Euclidean distance: ``query_id, chunk_id,
    case_id, distance``, equal distances by chunk id; the same hits as a scan of all chunks.

    ``queries`` holds ``query_id, embedding``; one without a vector has no hits.  A query whose
    vector is of another length than the chunks' ends the search with both lengths.  With
    ``counted`` each hit carries ``computed``, whose sum is the number of distances computed.
    """
    spark = queries.sparkSession
    kinds = dict(queries.dtypes)["query_id"], dict(index.chunks.dtypes)["chunk_id"]
    schema = f"query_id {kinds[0]}, chunk_id {kinds[1]}, case_id string, distance double, computed bigint"
    wanted = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    cells = [tuple(r) for r in index.cells().orderBy("pivot", "slice").collect()]
    names = ["query_id", "chunk_id", "case_id", "distance", *(["computed"] if counted else [])]
    if not cells:
        return spark.createDataFrame([], schema).select(names)
    pairs = wanted.mapInArrow(
        _bounds(index.pivots, cells, k),
        f"query_id {kinds[0]}, embedding array<double>, pivot int, slice int, lower double, first boolean, away double",
    )

    def ask(asked: DataFrame) -> DataFrame:
        met = asked.select("query_id", "embedding", "away", "limit", "pivot", "slice")
        chunks = index.chunks.join(met.select("pivot", "slice").distinct(), ["pivot", "slice"], "left_semi")
        return (
            met.groupBy("pivot", "slice").cogroup(chunks.groupBy("pivot", "slice")).applyInArrow(_cell_search(k, SLACK), schema)
        )

    order = [F.col("distance"), F.col("chunk_id")]
    near = checkpointed(ask(pairs.where("first").withColumn("limit", F.lit(None).cast("double"))))
    best = first_rows(near, ["query_id"], order, k, "__rank")
    limits = best.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("distance"))).alias("limit")
    )
    left = pairs.where(~F.col("first")).join(limits, "query_id").where(
        F.col("limit").isNull() | (F.col("lower") <= F.col("limit") * (1 + SLACK) + SLACK)
    )
    hits = near.unionByName(ask(left))
    return first_rows(hits, ["query_id"], order, k, "__rank").select(names) if not counted else hits.select(names)
