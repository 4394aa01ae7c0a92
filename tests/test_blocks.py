"""Blocks at quantiles: order kept, even sizes, frequent values cut by the next column."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.functions import ordered
from faultline.functions.blocks import cut_blocks
from faultline.operators import host, loads, sinks

SCHEMA = "k string, a double, b int, v int"


def hot_rows(total=3000):
    """One group with most rows, half of them of one value of ``a``; null keys and values."""
    rng = random.Random(5)
    rows = []
    for i in range(total):
        key = rng.choice(["hot"] * 8 + ["small", None])
        a = rng.choice([5.0, 5.0, None, rng.uniform(0, 10), float(rng.randint(0, 9))])
        rows.append((key, a, i, rng.randint(0, 9)))
    return rows


def in_order(row):
    return (row[1] is not None, row[1] or 0.0, row[2])


def groups(rows):
    found = {}
    for row in sorted(rows, key=in_order):
        found.setdefault(row[0], []).append(row)
    return found


@pytest.mark.parametrize("cuts", [2, 16])
def test_blocks_follow_the_order(frame, cuts):
    rows = hot_rows()
    got = cut_blocks(frame(rows, SCHEMA), ["k"], [F.col("a"), F.col("b")], block_rows=200, cuts=cuts).collect()
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, rows))
    block = {r.b: r.block for r in got}
    for key, group in groups(rows).items():
        numbers = [block[r[2]] for r in group]
        assert numbers == sorted(numbers)
        if len(group) <= 200:
            assert set(numbers) == {0}
        elif cuts == 16:  # a single value of at most block_rows rows stays whole
            assert max(numbers.count(n) for n in set(numbers)) <= max(200, len(group) // 8)
            assert len(set(numbers)) > 8


def test_ordered_computations_over_cut_blocks(frame):
    rows = hot_rows()
    cut = cut_blocks(frame(rows, SCHEMA), ["k"], [F.col("a"), F.col("b")], block_rows=200, cuts=8)
    got = ordered.running_sums(cut, ["k"], "block", [F.col("a"), F.col("b")], {"s": F.col("v")})
    want = {}
    for group in groups(rows).values():
        total = 0
        for row in group:
            total += row[3]
            want[row[2]] = total
    assert {r.b: r.s for r in got.collect()} == want


def test_one_day_is_many_blocks(frame):
    rows = [("h", 1, i, float((i * 37) % 101)) for i in range(1000)]
    samples = frame(rows, "host string, day int, n int, ram_used_percent double")
    blocks = cut_blocks(samples, ["host"], [F.col("day"), F.col("n")], block_rows=100, cuts=16)
    assert blocks.select("block").distinct().count() >= 16
    order = [F.col("day"), F.col("n")]

    def rows_of(**options):
        got = host.trend(samples, ["host"], order=order, **options)
        return sorted(map(tuple, got.select("n", "trend", "delta_percent").collect()))

    assert rows_of(block=None, block_rows=100) == rows_of(block="day")


def test_progress_without_a_block_column(frame):
    rows = [("d", "t", "r", i, 10, 1.0 + i, 5000) for i in range(300)]
    chunks = frame(rows, "dag_id string, task_id string, run_id string, chunk_no int, chunk_rows int, "
                         "elapsed_seconds double, total_rows long")
    got = loads.progress(chunks, loads.RUN_KEY, None, [F.col("chunk_no")])
    assert {r.chunk_no: r.rows_inserted for r in got.collect()} == {i: 10 * i for i in range(300)}
    assert "block" not in got.columns and "__block" not in got.columns


def test_report_ids_without_a_block_column(frame, monkeypatch):
    reports = frame(
        [("d", str(i), None, None, None, None, None, i // 50, i) for i in range(200)],
        "dag_id string, task_id string, root_cause string, business_impact string, resolution string, "
        "preventive_actions string, confidence_score string, day int, created_ts int")
    monkeypatch.setattr(sinks, "cut_blocks", lambda *a: cut_blocks(*a, block_rows=20, cuts=8))
    got = sinks.append_rca(frame([(7,)], "incident_id long"), reports, None, [F.col("created_ts")])
    assert {r.created_ts: r.incident_id for r in got.collect()} == {i: 8 + i for i in range(200)}


def test_empty_tables_no_keys_and_wrong_cuts(frame):
    rows = hot_rows(100)
    empty = cut_blocks(frame([], SCHEMA), ["k"], [F.col("a")], block_rows=10)
    assert empty.columns == ["k", "a", "b", "v", "block"] and empty.count() == 0
    got = cut_blocks(frame(rows, SCHEMA), [], [F.col("b")], block_rows=10, cuts=4).collect()
    numbers = [r.block for r in sorted(got, key=lambda r: r.b)]
    assert numbers == sorted(numbers) and len(set(numbers)) >= 4
    with pytest.raises(ValueError, match="power of two"):
        cut_blocks(frame(rows, SCHEMA), [], [F.col("b")], cuts=6)
