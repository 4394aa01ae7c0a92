"""Search through pivots gives the hits of a full scan, and looks at fewer chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import pivot_search, search

SCHEMA = "chunk_id long, incident_id string, embedding array<float>"


def vectors(spark, n, seed=1, same=0):
    rng = np.random.default_rng(seed)
    centers = np.random.default_rng(0).normal(0, 8, (12, 6))
    rows = [(i, f"c{i % 9}", (centers[i % 12] + rng.normal(0, 0.4, 6)).astype("float32").tolist()) for i in range(n)]
    rows += [(n + i, "same", [1.0] * 6) for i in range(same)] + [(n + same, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("k, pivots, slice_rows, same", [(5, 16, 50, 0), (7, 1, 40, 300), (1, 64, 10_000, 300), (900, 8, 100, 0)])
def test_hits_equal_a_full_scan(spark, tmp_path, k, pivots, slice_rows, same):
    chunks = vectors(spark, 600, same=same).cache()
    queries = vectors(spark, 25, seed=2, same=2).select(F.col("chunk_id").alias("query_id"), "embedding")
    index = pivot_search.build_index(chunks, str(tmp_path / "index"), pivots, slice_rows)
    assert index.chunks.count() == 600 + same
    sizes = [r["n"] for r in index.cells().collect()]
    assert len(sizes) >= min(pivots, 2) and max(sizes) <= 4 * slice_rows

    def listed(hits):
        return sorted((r.query_id, r.chunk_id, r.case_id, r.distance) for r in hits.collect())

    want = listed(search.nearest(queries, chunks, k))
    assert listed(pivot_search.nearest_by_pivots(queries, index, k)) == want
    if k == 5:
        computed = pivot_search.nearest_by_pivots(queries, index, k, counted=True).agg(F.sum("computed")).first()[0]
        assert computed < 0.35 * 27 * 600
    chunks.unpersist()


def test_edges(spark, tmp_path):
    chunks = vectors(spark, 30)
    index = pivot_search.build_index(chunks, str(tmp_path / "a"), 4)
    other = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="a query of 2 values for vectors of 6"):
        pivot_search.nearest_by_pivots(other, index, 3).collect()
    with pytest.raises(Exception, match=r"vectors of \[6\] values for queries of 2"):
        search.nearest(other, chunks, 3).collect()
    assert pivot_search.nearest_by_pivots(other.where("false"), index, 3).count() == 0
    none = pivot_search.build_index(chunks.where("false"), str(tmp_path / "b"), 4)
    assert pivot_search.nearest_by_pivots(other, none, 3).count() == 0
    mixed = chunks.union(spark.createDataFrame([(99, "x", [1.0])], SCHEMA))
    with pytest.raises(Exception, match="a vector of (1|6) values among vectors of (6|1)"):
        pivot_search.build_index(mixed, str(tmp_path / "c"), 40)
