import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline import rules
from faultline.operators import audit
from faultline.operators import database as d
from faultline.operators import host
from faultline.operators import loads, rca
from faultline.plans.load import export_products, load_products

CHUNK = ("run string, chunk_no int, chunk_rows long, elapsed_seconds double, total_rows long, "
         "sla_threshold long")


def breaches(frame, rows, **options):
    df = frame(rows, CHUNK).withColumn("block", F.floor(F.col("chunk_no") / 2))
    done = loads.progress(df, ["run"], "block", [F.col("chunk_no")], **options)
    return {r.run: r for r in loads.first_breach(done, ["run"], [F.col("chunk_no")]).collect()}


ROWS = [("late", i, 10, t, 40, 30) for i, t in enumerate([0.0, 30.0, 30.1, 50.0])]
ROWS += [("last", 0, 10, 1.0, 20, 30), ("last", 1, 10, 31.0, 20, 30)]
ROWS += [("fine", 0, 10, 1.0, 20, 30)] + [("at once", 0, 10, 99.0, 20, 30)]


def test_first_breach(frame):
    got = breaches(frame, ROWS)
    assert set(got) == {"late", "last", "at once"}
    late = got["late"]
    assert (late.rows_inserted, late.pct_complete, late.elapsed_seconds) == (20, 50.0, 30.1)
    assert (late.rows_per_second, late.eta_seconds, late.sla_breached_at) == (0.7, 30.1, 30.1)
    assert (got["at once"].rows_inserted, got["at once"].eta_seconds) == (0, 0.0)
    assert breaches(frame, ROWS, final_row=True)["late"].rows_inserted == 30


def test_zero_elapsed_and_total(frame):
    df = frame([("r", 0, 5, 0.0, 0, 1)], CHUNK).withColumn("block", F.lit(0))
    row = loads.progress(df, ["run"], "block", [F.col("chunk_no")]).first()
    assert (row.rows_per_second, row.eta_seconds, row.pct_complete) == (0.0, 0.0, 0.0)


def test_run_metrics_and_gap(frame):
    row = rca.run_metrics(frame([(30.1, 28.9, 30.1, 30), (0.0, 0.0, 5.0, 6)],
                                "elapsed_seconds double, eta_seconds double, sla_breached_at double, "
                                "sla_threshold long")).collect()
    assert [(r.elapsed_min, r.eta_min, r.sla_breach_by) for r in row] == [(0.5, 0.5, 0.1), (0.0, 0.0, -1.0)]
    df = frame([(14647.6, 3206.5), (90.0, 100.0), (89.0, 100.0), (0.0, 5.0), (5.0, None)], "c double, a double")
    gap = rca.perf_gap(F.col("c"), F.col("a"))
    got = [tuple(r) for r in df.select(*gap.values()).collect()]
    assert got == [(-356.8, "IMPROVING", "faster"), (10.0, "STABLE", "slower"), (11.0, "DEGRADING", "slower"),
                   (None, None, None), (None, None, None)]


def test_first_trigger_and_latest_failed(frame):
    events = frame([("r", 2, "failure"), ("r", 1, "breach"), ("s", 5, "failure")], "run string, at int, kind string")
    got = {r.run: r.kind for r in loads.first_trigger(events, ["run"], [F.col("at")]).collect()}
    assert got == {"r": "breach", "s": "failure"}
    rows = frame([(1, "d", "t", "FAILED"), (3, "d", "t", "SUCCESS"), (2, "d", "t", "FAILED"), (9, "d", "u", "FAILED")],
                 "audit_id long, dag_id string, task_id string, status string")
    tasks = frame([("d", "t"), ("d", "v")], "dag_id string, task_id string")
    found = {r.task_id: (r.audit_id, r.status, r.audit_status) for r in audit.latest_failed(rows, tasks).collect()}
    assert found == {"t": (2, "SUCCESS", "FAILED"), "v": (None, "NO_FAILURE_FOUND", None)}
    assert audit.failed_audits(rows, "d", "u").count() == 1


def test_product_check(frame):
    products = frame([(1, "n", "b", "c", "s", 0.0, 2.5), (2, "n2", "b", "c", "s", None, 1.0), (2, "n2", "b", "c", "s", None, 1.0)],
                     "product_id long, product_name string, brand string, category string, supplier_id string, "
                     "cost_price double, selling_price double")
    errors = frame([(1, "1"), (2, "2"), (3, "9"), (4, None), (5, "x")], "n int, product_id string")
    got = {r.n: r for r in loads.product_check(products, errors, F.xxhash64("n"), slice_rows=1).collect()}
    assert [got[i].exists for i in range(1, 6)] == [True, True, False, False, False]
    assert got[1].cost_price is None and got[1].selling_price == 2.5
    assert got[2].duplicate_detected and not got[1].duplicate_detected and got[4].total_rows == 3


def test_product_load_twice_and_export(spark, frame, tmp_path):
    source = tmp_path / "p.csv"
    header = [c.split()[0] for c in rules.PRODUCT_SCHEMA.split(", ")]
    line = '{},"a ""b"", c",c,b,,r,s,g,S1,sn,1.50,2.50,0.1,3,4,4.5,6,active,2024-01-05'
    source.write_text("\n".join([",".join(header)] + [line.format(i) for i in (1, 2, 2)]) + "\n")
    target = str(tmp_path / "table")
    first = load_products(spark, str(source), target).orderBy("product_id").collect()
    assert [r.product_id for r in first] == [1, 2] and first[0].product_name == 'a "b", c'
    assert first[0].created_date == dt.date(2024, 1, 5) and str(first[0].selling_price) == "2.50"
    assert load_products(spark, str(source), target).count() == 2
    assert export_products(spark, target, str(tmp_path / "out")) == 2


HOUR = dt.datetime(2026, 1, 1, 12)


def session_frame(frame):
    def ago(seconds):
        return HOUR - dt.timedelta(seconds=seconds)

    return frame([
        (HOUR, 1, "u", "active", "q1", ago(31), ago(40)), (HOUR, 2, "u", "active", "q2", ago(30), None),
        (HOUR, 3, "u", "idle", "", ago(1), None), (HOUR, 4, "u", None, "q", None, None),
        (HOUR, 5, "u", "idle in transaction", "q" * 300, None, None), (HOUR, 6, "u", "active", None, ago(0.5), None),
    ], "snapshot_ts timestamp, pid int, usename string, state string, query string, query_start timestamp, xact_start timestamp")


def test_sessions(frame):
    s = session_frame(frame)
    assert sorted(r.pid for r in d.live_sessions(s).collect()) == [1, 2, 5]
    assert sorted(r.pid for r in d.live_sessions(s, F.lit(1)).collect()) == [2, 5]
    assert [r.pid for r in d.long_active(s).collect()] == [1]
    timed = d.session_durations(s)
    slow = {r.pid: r.is_slow for r in d.flag_slow(timed).collect()}
    assert slow == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    assert timed.where("pid = 5").first().query_excerpt == "q" * 200
    assert [r.pid for r in d.order_sessions(s).collect()][:4] == [1, 2, 3, 6]
    states = {r.state: r.sessions for r in d.sessions_by_state(s).collect()}
    assert states == {"active": 3, "idle": 1, "unknown": 1, "idle in transaction": 1}
    share = d.saturation(d.session_totals(s), F.lit(9)).first()
    assert (share.total_connections, share.idle_in_transaction, share.connections_percent) == (6, 1, 66.67)
    assert d.saturation(d.session_totals(s), F.lit(0)).first().connections_percent is None


def test_lock_waits_with_nulls_and_skew(frame):
    schema = "snapshot_ts int, pid int, locktype string, database long, relation long, mode string, granted boolean"
    rows = [(1, 1, "relation", None, 5, "X", False), (1, 2, "relation", None, 5, "S", True),
            (1, 1, "relation", None, 5, "S", True), (1, 3, "relation", 7, None, "S", True),
            (1, 4, "relation", 7, None, "X", False), (2, 5, "relation", 7, None, "X", False)]
    rows += [(3, i, "tuple", 1, 1, "X", i % 3 == 0) for i in range(60)]
    people = frame([(t, p, f"u{p}", "q" * 250) for t, p in {(r[0], r[1]) for r in rows}],
                   "snapshot_ts int, pid int, usename string, query string")
    locks = frame(rows, schema)
    got, sliced = (
        sorted((r.snapshot_ts, r.blocked_pid, r.blocking_pid) for r in waits.collect())
        for waits in (d.lock_waits(locks, people), d.lock_waits(locks, people, slice_rows=3))
    )
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows
                  if a[:1] + a[2:5] == b[:1] + b[2:5] and a[1] != b[1] and not a[6] and b[6])
    assert got == want and sliced == want
    plan = d.lock_waits(locks, people)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    total = {r.snapshot_ts: (r.waiting_locks_total, r.granted_locks_total) for r in d.lock_totals(locks).collect()}
    assert total == {1: (2, 3), 2: (1, 0), 3: (40, 20)}


def test_pressure_and_counters(frame):
    locks = frame([(HOUR, False), (HOUR, True), (HOUR + dt.timedelta(hours=1), False)], "snapshot_ts timestamp, granted boolean")
    rows = d.pressure_counts(session_frame(frame), locks).orderBy("snapshot_ts").collect()
    assert [(r.slow_queries_over_threshold, r.waiting_locks) for r in rows] == [(1, 1), (0, 1)]
    hits = d.hit_ratio(frame([(90, 10), (0, 0), (None, 4)], "blks_hit long, blks_read long")).collect()
    assert [r.buffer_hit_ratio_pct for r in hits] == [90.0, None, 0.0]


def grade(frame, values, schema, expression):
    return [r[0] for r in frame(values, schema).select(expression).collect()]


def test_health_grades(frame):
    cpu = host.cpu_health(F.col("p"), F.col("l"), F.col("c"), F.col("w"))
    assert grade(frame, [(92.4, 7.8, 4, 14.2), (50.0, None, None, None), (70.1, 0.0, 4, None), (1.0, 4.9, 4, 0.0),
                         (1.0, 1.3, 0, 0.0), (1.0, 0.0, 1, 25.1), (90.0, 0.0, 4, 10.0)],
                 "p double, l double, c int, w double", cpu) == [
        "CRITICAL", "HEALTHY", "WARNING", "WARNING", "WARNING", "CRITICAL", "WARNING"]
    mem = host.memory_health(F.col("r"), F.col("s"), F.col("o"), F.col("t"))
    assert grade(frame, [(81.3, 12.0, False, "RISING"), (91.0, 0.0, False, ""), (1.0, 0.0, True, ""),
                         (1.0, 0.0, None, "RISING"), (85.0, 10.0, False, "STABLE"), (1.0, 40.1, False, "")],
                 "r double, s double, o boolean, t string", mem) == [
        "WARNING", "CRITICAL", "CRITICAL", "MONITOR", "HEALTHY", "CRITICAL"]
    schema = "connections_percent double, waiting_locks long, slow_queries_over_threshold long, st string"
    assert grade(frame, [(88.0, 1, 2, "SUCCESS"), (91.0, 0, 0, "SUCCESS"), (None, 0, 0, "SUCCESS"), (1.0, 6, 0, "SUCCESS"),
                         (1.0, 0, 0, "ERROR"), (1.0, 0, 0, None)], schema, d.activity_health(F.col("st"))) == [
        "WARNING", "CRITICAL", "HEALTHY", "CRITICAL", "UNKNOWN", "UNKNOWN"]
    worst = host.overall_health(F.col("a"), F.col("b"), F.col("c"))
    assert grade(frame, [("CRITICAL", "WARNING", "WARNING"), ("HEALTHY", "MONITOR", "UNKNOWN"), ("UNKNOWN",) * 3,
                         ("WARNING", "MONITOR", "HEALTHY")], "a string, b string, c string", worst) == [
        "CRITICAL", "MONITOR", "HEALTHY", "WARNING"]


def test_runtime_health_and_issues(frame):
    schema = "slow_query_count long, waiting_locks_total long, deadlocks long, temp_files long, buffer_hit_ratio_pct double"
    rows = frame([(0, 0, 0, 0, 95.0), (2, 0, 0, 0, None), (0, 0, None, None, 89.5), (1, 2, 3, 4, 50.0)], schema)
    got = rows.select(d.runtime_health(), d.runtime_issues()).collect()
    assert [r[0] for r in got] == ["HEALTHY", "WARNING", "WARNING", "CRITICAL"]
    assert got[0][1] == [] and got[1][1] == ["2 slow/active query(s) >= 1s"]
    assert got[3][1] == [
        "1 slow/active query(s) >= 1s", "2 waiting lock(s) — possible contention", "3 deadlock(s) recorded since stats reset",
        "4 temp file(s) used — possible work_mem pressure", "Buffer hit ratio low at 50.0% — possible insufficient shared_buffers"]


@pytest.mark.parametrize("block_rows", [11, 100_000])
def test_trend(frame, block_rows):
    rng = random.Random(1)
    rows = [("hot", i // 30, i, float(rng.randint(0, 20))) for i in range(200)] + [("one", 0, 1, 3.0)]
    got = host.trend(frame(rows, "host string, day int, n int, ram_used_percent double"), ["host"], "day",
                     [F.col("n")], block_rows=block_rows).collect()
    values = [r[3] for r in rows[:200]]
    for r in got:
        if r.host == "one":
            assert (r.trend, r.delta_percent) == ("INSUFFICIENT_DATA", 0.0)
        elif r.n > 0:
            delta = values[r.n] - values[max(0, r.n - 9)]
            assert r.delta_percent == delta
            assert r.trend == ("RISING" if delta > 5 else "FALLING" if delta < -5 else "STABLE")
    assert len(got) == 201
