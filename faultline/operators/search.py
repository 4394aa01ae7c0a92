"""Semantic search over chunk vectors, for a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import rules
from faultline.functions.ordered import first_rows, sliced_join
from faultline.session import checkpointed

#: Query rows and vector values of one block, which the driver and every task hold.
BLOCK_QUERIES = 4096
BLOCK_VALUES = 4_194_304


def query_text(error_type: Column, error_message: Column) -> Column:
    """Search text of an incident."""
    return F.concat_ws(" ", error_type, error_message)


def embed(df: DataFrame, text: str, function, name: str = "embedding") -> DataFrame:
    """Optional hook: vectors from a function of a text Series, in Arrow batches."""
    wrapped = F.pandas_udf(function, T.ArrayType(T.FloatType()))
    return df.withColumn(name, wrapped(F.col(text)))


def _scan(blocks: list, limit: int, metric: str):
    """A function that keeps the best hits of a partition of chunks, batch after batch, for each
    query of ``blocks``, a list of (number, queries).

    One matrix product per block and batch tells which chunks can be among the nearest of a query,
    those kept from earlier batches included; their distances are then computed one by one, so
    rounding in the product decides nothing.
    """

    def scan(batches):
        import numpy as np
        import pandas as pd

        def distances(rows, vector):
            if metric == "l2":
                return np.square(rows - vector).sum(axis=1)
            products = (rows * vector).sum(axis=1)
            if metric == "ip":
                return 1.0 - products
            norms = np.linalg.norm(rows, axis=1) * np.linalg.norm(vector)
            return 1.0 - products / np.where(norms == 0, 1.0, norms)

        def estimates(asked, asked_squares, rows, squares):
            """Distances of all queries by all rows, and how far each may be off."""
            products = asked @ rows.T
            scale = asked_squares[:, None] + squares[None, :]
            if metric == "l2":
                return scale - 2.0 * products, scale * 1e-9
            if metric == "ip":
                return 1.0 - products, scale * 1e-9
            norms = np.sqrt(asked_squares[:, None] * squares[None, :])
            cosines = np.divide(products, norms, out=np.zeros_like(products), where=norms != 0)
            return 1.0 - cosines, np.full_like(products, 1e-9)

        asking = []
        for _, queries in blocks:
            if len({len(v) for _, v in queries}) > 1:
                raise ValueError(f"queries of {sorted({len(v) for _, v in queries})} values")
            asked = np.stack([v for _, v in queries])
            # the distance that a further hit of each query may not pass, and its hits so far
            asking.append((asked, np.square(asked).sum(axis=1), np.full(len(queries), np.inf), [None] * len(queries)))
        for batch in batches:
            if batch.empty:
                continue
            ids, owners = batch["chunk_id"].to_numpy(), batch["case_id"].to_numpy()
            lengths = {len(v) for v in batch["embedding"]}
            for asked, *_ in asking:
                if lengths != {asked.shape[1]}:
                    raise ValueError(f"vectors of {sorted(lengths)} values for queries of {asked.shape[1]}")
            matrix = np.stack(batch["embedding"].to_numpy()).astype("float64")
            squares = np.square(matrix).sum(axis=1)
            for asked, asked_squares, edges, kept in asking:
                about, slack = estimates(asked, asked_squares, matrix, squares)
                bound = edges
                if len(ids) > limit and np.isinf(edges).any():
                    here = np.partition(about + slack, limit - 1, axis=1)[:, limit - 1]
                    bound = np.where(np.isinf(edges), here, edges)
                # written so that a distance that is no number is looked at, too
                near = ~(about - slack > bound[:, None])
                for place in np.flatnonzero(near.any(axis=1)):
                    rows = np.flatnonzero(near[place])
                    hits = distances(matrix[rows], asked[place]), ids[rows], owners[rows]
                    if kept[place] is not None:
                        hits = tuple(np.concatenate(pair) for pair in zip(kept[place], hits))
                    order = np.lexsort((hits[1], hits[0]))[:limit]
                    kept[place] = tuple(values[order] for values in hits)
                    if len(order) == limit:
                        edges[place] = kept[place][0][-1]
        for (number, queries), (*_, kept) in zip(blocks, asking):
            found = [(name, hits) for (name, _), hits in zip(queries, kept) if hits is not None]
            if found:
                yield pd.DataFrame(
                    {
                        "block": number,
                        "query_id": [name for name, hits in found for _ in hits[0]],
                        "chunk_id": np.concatenate([hits[1] for _, hits in found]),
                        "case_id": np.concatenate([hits[2] for _, hits in found]),
                        "distance": np.concatenate([hits[0] for _, hits in found]),
                    }
                )

    return scan


def _blocks(queries: DataFrame, rows: int, values: int):
    """The queries as lists of (id, vector), each of at most ``rows`` rows and ``values`` values
    (a longer vector stands alone), read partition by partition."""
    import numpy as np

    block, held = [], 0
    for query in queries.toLocalIterator():
        vector = np.asarray(query["embedding"], dtype="float64")
        if block and (len(block) >= rows or held + len(vector) > values):
            yield block
            block, held = [], 0
        block.append((query["query_id"], vector))
        held += len(vector)
    if block:
        yield block


def _rounds(blocks):
    """Numbered blocks that one scan of the chunks serves: as many as have the rows and values of
    the largest block, or one that is larger."""
    held, rows, values = [], 0, 0
    for number, block in enumerate(blocks):
        size = sum(len(vector) for _, vector in block)
        if held and (rows + len(block) > BLOCK_QUERIES or values + size > BLOCK_VALUES):
            yield held
            held, rows, values = [], 0, 0
        held.append((number, block))
        rows, values = rows + len(block), values + size
    if held:
        yield held


def nearest(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    metric: str = "l2",
    block_queries: int = BLOCK_QUERIES,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """The ``k`` nearest chunks per query: ``query_id, chunk_id, case_id, distance``.

    ``queries`` holds ``query_id, embedding``, ``chunks`` holds ``chunk_id,
    embedding`` and may hold ``incident_id``, which goes along as ``case_id`` so that
    hits need not be joined with the chunk table again.  Exact search; a query or a chunk
    without a vector has no hits.  The queries go block by block to the tasks, which scan
    the chunks where they lie and give back ``k`` hits per query and partition; neither the
    chunks nor the queries are copied through a shuffle.  A scan serves as many blocks as have
    ``BLOCK_QUERIES`` rows and ``BLOCK_VALUES`` values in all, one after the other for each batch
    of chunks; their hits are checkpointed before further blocks are read, so driver and tasks
    hold no more queries than that, or one larger block.
    """
    spark = queries.sparkSession
    kinds = dict(queries.dtypes), dict(chunks.dtypes)
    schema = (
        f"query_id {kinds[0]['query_id']}, chunk_id {kinds[1]['chunk_id']}, "
        "case_id string, distance double"
    )
    owner = F.col("incident_id") if "incident_id" in chunks.columns else F.lit(None)
    wanted = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    stored = chunks.where(F.col("embedding").isNotNull()).select(
        "chunk_id", owner.cast("string").alias("case_id"), "embedding"
    )
    result = spark.createDataFrame([], schema)
    for blocks in _rounds(_blocks(wanted, block_queries, block_values)):
        partial = stored.mapInPandas(_scan(blocks, k, metric), f"block long, {schema}")
        best = first_rows(
            partial, ["block", "query_id"], [F.col("distance"), F.col("chunk_id")], k, "__rank"
        ).drop("__rank", "block")
        result = result.unionByName(checkpointed(best))
    return result


def rank_hits(hits: DataFrame, limit: int) -> DataFrame:
    """``semantic_rank`` from 1 by distance, the best ``limit`` hits per query."""
    order = [F.col("distance"), F.col("chunk_id")]
    return first_rows(hits, ["query_id"], order, limit, "semantic_rank").withColumnRenamed(
        "distance", "semantic_distance"
    )


def candidate_count(k: int, multiplier: int = rules.CANDIDATE_MULTIPLIER) -> int:
    """Hits to fetch so that ``k`` cases are left after chunks fold into cases.  A
    store with fewer chunks simply gives them all."""
    return k * multiplier


def candidates(
    hits: DataFrame, k: int = rules.TOP_K_CASES, multiplier: int = rules.CANDIDATE_MULTIPLIER
) -> DataFrame:
    return rank_hits(hits, candidate_count(k, multiplier))


def hit_case_id(metadata: Column) -> Column:
    """Case id of a hit: the first of six metadata entries that is not empty."""
    return F.coalesce(*[F.nullif(metadata[key], F.lit("")) for key in rules.HIT_ID_KEYS])


def unique_cases(hits: DataFrame, case_id: str = "case_id") -> DataFrame:
    """Each case once per query, numbered in the order of its best hit.

    A query has at most as many rows here as hits were fetched for it.
    """
    best = (
        hits.where(F.col(case_id).isNotNull())
        .groupBy("query_id", case_id)
        .agg(F.min("semantic_rank").alias("best_rank"))
    )
    window = Window.partitionBy("query_id").orderBy("best_rank")
    return best.withColumn("case_rank", F.row_number().over(window))


def top_cases(cases: DataFrame, k: int = rules.TOP_K_CASES) -> DataFrame:
    return cases.where(F.col("case_rank") <= k)


def top_incidents(cases: DataFrame, n: int = 3) -> DataFrame:
    """The first cases of each query as one ordered list."""
    rest = [c for c in cases.columns if c not in ("query_id", "case_rank")]
    return (
        cases.where(F.col("case_rank") <= n)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("case_rank", *rest))).alias("incidents"))
    )


def rank_similarity(rank: Column) -> Column:
    """1.0 for the first case and 0.05 less for each one after it (rank from 1)."""
    return F.round(F.lit(1.0) - (rank - 1) * rules.SIMILARITY_STEP, 4)


def lookup_cases(
    cases: DataFrame, wanted: DataFrame, spread: Column, slice_rows: int = 2_000_000
) -> DataFrame:
    """The stored case for each wanted id, tried through the id columns in order.

    ``wanted`` holds ``case_id``.  Of the rows matched by the first column that
    matches at all, the one with the smallest ``incident_id`` is taken.  Only the id
    columns are unpivoted, and each id value keeps one row, so a value shared by many
    cases does not multiply.
    """
    sought = wanted.select("case_id").distinct()
    match = first_places(case_places(cases).join(sought, "case_id", "left_semi"))
    return with_cases(wanted, match, cases, spread, slice_rows)


def case_places(cases: DataFrame) -> DataFrame:
    """``case_id, priority, incident_id``: every id under which a case can be asked for."""
    names = [c for c in rules.CASE_LOOKUP_COLUMNS if c in cases.columns]
    options = F.array(
        *[
            F.struct(F.lit(i).alias("priority"), F.col(c).cast("string").alias("case_id"))
            for i, c in enumerate(names)
        ]
    )
    return (
        cases.select("incident_id", F.explode(options).alias("__option"))
        .select("__option.case_id", "__option.priority", "incident_id")
        .where(F.col("case_id") != "")
    )


def first_places(places: DataFrame) -> DataFrame:
    """``case_id`` and the case it stands for, ``__found``."""
    return places.groupBy("case_id").agg(
        F.min(F.struct("priority", "incident_id"))["incident_id"].alias("__found")
    )


def with_cases(
    wanted: DataFrame, match: DataFrame, cases: DataFrame, spread: Column, slice_rows: int = 2_000_000
) -> DataFrame:
    """``wanted`` with the case that ``match`` names for its ``case_id``."""
    rows = cases.withColumn("__found", F.col("incident_id"))
    rows = rows.select(*[F.col(c).alias(f"stored_{c}") if c in wanted.columns else F.col(c)
                         for c in rows.columns])
    full = match.join(rows, "__found").drop("__found")
    return sliced_join(wanted, full, ["case_id"], spread, "inner", slice_rows)


def is_empty(chunks: DataFrame) -> bool:
    """True when the store holds no chunk; one row is probed."""
    return chunks.isEmpty()
