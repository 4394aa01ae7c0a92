import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import benchmarks as b
from faultline.operators import search
from faultline.plans.retrieve import retrieve


def vectors(n, size=6, seed=3):
    rng = random.Random(seed)
    return [[rng.choice([0.0, 0.5, 1.0]) for _ in range(size)] for _ in range(n)]


def brute(queries, chunks, k):
    hits = []
    for q, v in queries:
        found = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in chunks)[:k]
        hits += [(q, i, d) for d, i in found]
    return sorted(hits)


@pytest.mark.parametrize("sizes", [(4096, 4_194_304), (2, 4_194_304), (4096, 13), (4096, 1)])
def test_nearest_equals_brute_force_in_any_blocks(frame, sizes):
    chunks = list(enumerate(vectors(150)))
    queries = [(f"q{i}", v) for i, v in enumerate(vectors(7, seed=9))]
    got = search.nearest(
        frame(queries, "query_id string, embedding array<double>"),
        frame(chunks, "chunk_id long, embedding array<double>"),
        5, block_queries=sizes[0], block_values=sizes[1],
    )
    assert sorted((r.query_id, r.chunk_id, r.distance) for r in got.collect()) == brute(queries, chunks, 5)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_nearest_of_close_vectors_far_from_the_origin(frame, metric):
    """The matrix product alone would round these distances away."""
    import numpy as np

    rng = random.Random(5)
    chunks = [(i, [1e4 + rng.random() * 1e-3 for _ in range(5)]) for i in range(300)]
    query = [1e4] * 5
    got = search.nearest(
        frame([("q", query)], "query_id string, embedding array<double>"),
        frame(chunks, "chunk_id long, embedding array<double>").coalesce(1), 7, metric,
    ).orderBy("distance", "chunk_id")

    def distance(v):
        v, w = np.array([v]), np.array(query)
        if metric == "l2":
            return np.square(v - w).sum(axis=1)[0]
        dot = (v * w).sum(axis=1)[0]
        return 1 - dot if metric == "ip" else 1 - dot / (np.linalg.norm(v, axis=1)[0] * np.linalg.norm(w))

    best = sorted((distance(v), i) for i, v in chunks)[:7]
    assert [(r.distance, r.chunk_id) for r in got.collect()] == best


def test_queries_and_chunks_without_a_vector_have_no_hits(frame):
    queries = frame([("q", None), ("r", [1.0])], "query_id string, embedding array<double>")
    chunks = frame([(1, None), (2, [3.0])], "chunk_id long, embedding array<double>")
    assert [tuple(r) for r in search.nearest(queries, chunks, 2).collect()] == [("r", 2, None, 4.0)]
    assert search.nearest(queries.where("query_id = 'q'"), chunks, 2).collect() == []


def test_other_metrics(frame):
    chunks = frame([(1, [1.0, 0.0]), (2, [5.0, 5.0])], "chunk_id long, embedding array<double>")
    queries = frame([("q", [1.0, 1.0])], "query_id string, embedding array<double>")

    def ids(metric):
        rows = search.nearest(queries, chunks, 1, metric).collect()
        return [(r.chunk_id, round(r.distance, 6)) for r in rows]

    assert ids("l2") == [(1, 1.0)] and ids("cosine") == [(2, 0.0)] and ids("ip") == [(2, -9.0)]


def test_empty_store(frame):
    chunks = frame([], "chunk_id string, incident_id string, embedding array<float>")
    queries = frame([("q", [1.0])], "query_id string, embedding array<double>")
    cases = frame([], "incident_id string, title string")
    assert retrieve(queries, chunks, cases).collect() == []
    assert search.is_empty(chunks)


def test_unique_cases_and_similarity(frame):
    hits = frame([("q", 1, "b"), ("q", 2, "a"), ("q", 3, "b"), ("q", 4, None), ("r", 1, "a")],
                 "query_id string, semantic_rank int, case_id string")
    rows = search.top_cases(search.unique_cases(hits), 2).collect()
    assert sorted((r.query_id, r.case_rank, r.case_id) for r in rows) == [
        ("q", 1, "b"), ("q", 2, "a"), ("r", 1, "a")]
    ranks = frame([(1,), (2,), (7,)], "r int").select(search.rank_similarity(F.col("r")))
    assert [r[0] for r in ranks.collect()] == [1.0, 0.95, 0.7]


def test_hit_case_id(frame):
    rows = frame([({"incident_id": "", "ticket_id": "t"},), ({"id": "i"},), ({},)], "m map<string,string>")
    assert [r[0] for r in rows.select(search.hit_case_id(F.col("m"))).collect()] == ["t", "i", None]


def test_lookup_prefers_earlier_id_columns(frame):
    cases = frame([("c1", "x"), ("x", "y"), ("c3", "x"), ("c4", "z"), ("c2", "z")],
                  "incident_id string, ticket_id string")
    wanted = frame([(1, "x"), (2, "z"), (3, "none"), (4, "y")], "n int, case_id string")
    got = search.lookup_cases(cases, wanted, F.xxhash64("n"), slice_rows=1).collect()
    assert sorted((r.n, r.incident_id) for r in got) == [(1, "x"), (2, "c2"), (4, "x")]


INCIDENT = ("q string, incident_id string, record_volume string, rows_per_second string, "
            "elapsed_seconds string, insert_method string, batch_size string, "
            "fix_reduced_time_by_pct string, fix_applied string, case_rank int")


def incident_frame(frame):
    return frame([
        ("a", "1", "50", "10", "1", "copy", "5", "20", "f1", 1),
        ("a", "2", "150", "20", "", "copy", "5", "30", "f2", 2),
        ("a", "3", "151", "999", "", "row", "9", "90", "f3", 3),
        ("a", "4", "0", "999", "", "row", "9", "", "f4", 4),
        ("a", "5", "abc", "nan", "-1", "row", "9", "99", "f5", 5),
        ("b", "6", "1", "1", "1", "", "0", "0", "f6", 1),
    ], INCIDENT)


def test_volume_band_and_fallback(frame):
    incidents = b.to_incident(incident_frame(frame).withColumnRenamed("q", "query_id"))
    runs = frame([("a", 100), ("b", 100)], "query_id string, current_volume long")
    band = b.volume_band(incidents, runs, "query_id", F.xxhash64("incident_id"), slice_rows=1)
    assert sorted(r.incident_id for r in band.collect()) == ["1", "2", "6"]
    assert {r.incident_id: r.volume_matched for r in band.collect()} == {"1": True, "2": True, "6": False}


def test_benchmarks(frame):
    incidents = b.to_incident(incident_frame(frame).withColumnRenamed("q", "query_id"))
    runs = frame([("a", 100), ("b", 100)], "query_id string, current_volume long")
    band = b.volume_band(incidents, runs, "query_id", F.xxhash64("incident_id")).drop("current_volume")
    rows = {r.query_id: r for r in b.full_benchmarks(band, ["query_id"], F.col("case_rank")).collect()}
    a = rows["a"]
    assert (a.benchmark_incident_count, a.avg_rows_per_second, a.best_rows_per_second) == (2, 15.0, 20.0)
    assert (a.avg_elapsed_seconds, a.avg_improvement_pct) == (1.0, 25.0)
    assert (a.common_insert_method, a.common_batch_size, a.most_successful_fix) == ("copy", 5, "f2")
    z = rows["b"]
    assert (z.common_insert_method, z.common_batch_size, z.most_successful_fix) == ("Unknown", 0, "")
    one_pass = b.benchmarks(incidents.join(runs, "query_id"), ["query_id"]).collect()
    got = {r.query_id: (r.benchmark_incident_count, r.avg_rows_per_second, r.volume_matched) for r in one_pass}
    assert got == {"a": (2, 15.0, True), "b": (1, 1.0, False)}


def test_mode_tie_goes_to_the_smaller_value(frame):
    rows = frame([("g", "b"), ("g", "a"), ("h", "")], "g string, m string")
    got = {r.g: r.common_m for r in b.common_value(rows, "m", ["g"], F.lit("Unknown")).collect()}
    assert got == {"g": "a", "h": "Unknown"}


def test_missing_columns_become_empty(frame):
    row = b.to_incident(frame([("x",)], "incident_id string")).first()
    assert row.incident_id == "x" and row.priority == "" and row.record_volume == 0


def test_embed_hook(frame):
    df = search.embed(frame([("ab",)], "t string"), "t", lambda s: s.map(lambda v: [float(len(v))]))
    assert df.first().embedding == [2.0]


def test_small_blocks_share_a_scan(frame, monkeypatch):
    scans = []
    monkeypatch.setattr(search, "checkpointed", lambda df: scans.append(1) or df)
    chunks = list(enumerate(vectors(60)))
    queries = [(f"q{i // 2}", v) for i, v in enumerate(vectors(30, seed=9))]
    got = search.nearest(
        frame(queries, "query_id string, embedding array<double>"),
        frame(chunks, "chunk_id long, embedding array<double>"), 5, block_queries=3,
    )
    # an id that comes twice has 5 hits per block that holds it
    assert got.groupBy("query_id").count().agg(F.sum("count")).first()[0] == 5 * (15 + 5)
    assert len(scans) == 1
