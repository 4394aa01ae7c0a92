from pyspark.sql import functions as F

from faultline import rules
from faultline.operators import rca, report
from faultline.plans.evidence import database_evidence, history_evidence, host_evidence
from faultline.plans.incident import analyse, summarise

KEY = "dag_id string, task_id string, run_id string"


def evidence(frame, **changes):
    base = {
        "log": ([("d", "t", "r", "SUCCESS", "SLAMiss", "over SLA", None)],
                KEY + ", status string, error_type string, error_message string, product_id string"),
        "audit": ([("d", "t", "SUCCESS", "FAILED", "SLA exceeded")],
                  "dag_id string, task_id string, status string, audit_status string, error_message string"),
        "product": ([("d", "t", "r", "SUCCESS", False, None)], KEY + ", status string, exists boolean, product_name string"),
        "history": ([("d", "t", "r", "SUCCESS", 7, True, "INC052")],
                    KEY + ", status string, incidents_found long, has_benchmarks boolean, top_match_id string"),
        "host": ([("d", "t", "r", "SUCCESS", "CRITICAL", "CRITICAL", "WARNING", "WARNING")],
                 KEY + ", status string, overall_health string, cpu_health string, memory_health string, postgres_health string"),
        "runtime": ([("d", "t", "r", "SUCCESS", "CRITICAL", True)], KEY + ", status string, health string, has_counters boolean"),
        "perf": ([("d", "t", "r", 1000000, 440000, 44.0, 30.0, 14647.6, 38.2, 30, 30.0, 10000, "execute_values", 0.5, 0.6, 0.0)],
                 KEY + ", total_rows long, rows_inserted long, pct_complete double, elapsed_seconds double, "
                 "rows_per_second double, eta_seconds double, sla_threshold long, sla_breached_at double, chunk_size long, "
                 "insert_method string, elapsed_min double, eta_min double, sla_breach_by double"),
    }
    made = {}
    for kind, (rows, schema) in base.items():
        keys = ["dag_id", "task_id"] if kind == "audit" else ["dag_id", "task_id", "run_id"]
        made[kind] = (frame(changes.get(kind, rows), schema), keys)
    return made


def triggers(frame):
    return frame([("d", "t", "r"), ("d", "t", "other")], KEY)


def test_confidence_without_whole_kinds(frame):
    given = evidence(frame)
    full = {r.run_id: r.s for r in rca.assemble(triggers(frame), given).select(
        "run_id", rca.confidence().alias("s")).collect()}
    for kind in given:
        rest = {k: v for k, v in given.items() if k != kind}
        rows = rca.assemble(triggers(frame), rest).withColumn("s", rca.confidence()).collect()
        assert all(r.s <= full[r.run_id] for r in rows) and len(rows) == len(full)
    bare = rca.assemble(triggers(frame), {}).withColumn("s", rca.confidence()).first()
    assert bare.s == 0.0 and bare.log.status == "MISSING" and bare.errors == []


def test_assembly_and_confidence(frame):
    rows = rca.assemble(triggers(frame), evidence(frame), slice_rows=1).withColumn("score", rca.confidence())
    got = {r.run_id: r for r in rows.collect()}
    assert len(got) == 2
    # 20+10 log, 10+10 audit, 10 product, 20+5 history, 5+5 host, 5 performance, 5+5+5 runtime
    assert got["r"].score == 1.0 and got["r"].errors == []
    other = got["other"]
    assert other.log.status == "MISSING" and other.host.overall_health == "UNKNOWN"
    assert other.history.incidents_found == 0 and other.audit.status == "SUCCESS"
    assert other.score == 0.2


def test_each_weight_counts(frame):
    def score(**changes):
        rows = rca.assemble(triggers(frame), evidence(frame, **changes)).select("run_id", rca.confidence().alias("s"))
        return {r.run_id: r.s for r in rows.collect()}["r"]

    none = {kind: [] for kind in ("log", "audit", "product", "history", "host", "runtime", "perf")}
    assert score(**none) == 0.0
    for kind, rows, want in [
        ("log", [("d", "t", "r", "SUCCESS", "Unknown", "", "")], 0.2),
        ("log", [("d", "t", "r", "SUCCESS", "DataError", "", "5")], 0.4),
        ("log", [("d", "t", "r", "ERROR", "DataError", "", "5")], 0.0),
        ("history", [("d", "t", "r", "SUCCESS", 1, False, "")], 0.1),
        ("history", [("d", "t", "r", "SUCCESS", 2, True, "")], 0.25),
        ("product", [("d", "t", "r", "SUCCESS", True, "p")], 0.2),
        ("host", [("d", "t", "r", "SUCCESS", "HEALTHY", "", "", "")], 0.05),
        ("runtime", [("d", "t", "r", "SUCCESS", "HEALTHY", True)], 0.1),
        ("runtime", [("d", "t", "r", "SUCCESS", "WARNING", False)], 0.1),
    ]:
        assert score(**{**none, kind: rows}) == want, (kind, rows)


def test_errors_are_merged_once(frame):
    df = frame([(["a", None], ["b", "a"], None)], "x array<string>, y array<string>, z array<string>")
    assert df.select(rca.merge_errors(F.col("x"), F.col("y"), F.col("z"))).first()[0] == ["a", "b"]
    failed = [("d", "t", "r", "ERROR", "", "", "")]
    rows = rca.assemble(triggers(frame), evidence(frame, log=failed)).collect()
    assert {r.run_id: r.errors for r in rows} == {"r": ["log: failed"], "other": []}


RESPONSE = (
    "noise <summary>\n 1M load late \n</summary><root_cause>slow\ninserts</root_cause>"
    "<resolution>1. Increase chunk size\n2) Switch to COPY\n3.Re-trigger\n4. x</resolution>"
    "<preventive_actions>no numbers</preventive_actions><sla_analysis>a\n\n b \nc\nd\ne</sla_analysis>"
    "<performance_insights>{}</performance_insights><summary>second</summary>"
)
INSIGHTS = (
    "CURRENT RUN STATUS:\n- Total records: 1,000,000\nHISTORICAL BENCHMARK COMPARISON:\n"
    "- Historical average throughput: 3206.5 rows/sec (from 7 incidents)\n- Historical average runtime: 265.6 seconds\n"
    "- Current throughput: 16931.0 rows/sec\n- Performance gap: -427.9% — current run is faster\n- Trend: IMPROVING\n"
    "- Most successful historical fix: batch_size=50000\n- Historical improvement achieved: 53.0%\n"
    "BOTTLENECK DETECTION:\n- none\n"
)


def test_sections(frame):
    row = rca.report_sections(frame([(RESPONSE,), (None,)], "response_text string")).collect()
    assert row[0].summary == "1M load late" and row[0].root_cause == "slow\ninserts"
    assert row[0].confidence_score == "" and row[1].summary == ""


def one(frame, value, *expressions):
    return list(frame([(value,)], "v string").select(*[e(F.col("v")) for e in expressions]).first())


def test_section_lines(frame):
    ours, strict = one(frame, INSIGHTS, report.section_lines, lambda c: report.section_lines(c, strict_reference=True))
    content = [line for line in INSIGHTS.split("\n") if line.startswith("-")]
    assert ours == content[1:7] and strict == content[1:4]
    assert one(frame, "none\nA slower than B\nx", report.comparison_lines, report.best_fix_line) == [["A slower than B"], None]
    assert one(frame, INSIGHTS, report.best_fix_line) == ["- Most successful historical fix: batch_size=50000"]
    assert one(frame, None, report.section_lines, report.sla_summary) == [[], "SLA analysis not available"]
    assert one(frame, "a\n\n b \nc\nd\ne", report.sla_summary) == ["a | b | c | d"]


def test_steps(frame):
    text = "1. Increase chunk size\n2. Switch to COPY\n3. Re-trigger DAG"
    assert one(frame, text, report.resolution_steps) == [["Increase chunk size", "Switch to COPY", "Re-trigger DAG"]]
    assert one(frame, "1) a\nb", report.preventive_steps) == [["a"] + [rules.PREVENTION_PADDING] * 2]
    assert one(frame, None, report.resolution_steps) == [rules.RESOLUTION_DEFAULTS]
    assert one(frame, "  ", report.resolution_steps) == [[rules.RESOLUTION_PADDING] * 3]


def test_impact_constraint_severity(frame):
    rows = frame([("SLAMiss", "", "", ""), ("X", "an SLA text", None, None), ("X", "", "FAILED", "SUCCESS"),
                  (None, None, None, "NO_FAILURE_FOUND"), (None, None, None, "ERROR"), ("X", "sla", None, "MISSING")],
                 "t string, m string, a string, s string")
    got = [tuple(r[0]) for r in rows.select(report.impact(*[F.col(c) for c in "tmas"])).collect()]
    assert got == [rules.IMPACT_SLA, rules.IMPACT_SLA, rules.IMPACT_FAILED, rules.IMPACT_NONE, rules.IMPACT_FAILED,
                   rules.IMPACT_FAILED]
    names = ['x Unique Constraint "a_b"', "violates constraint 'c1' and unique constraint d2", "check constraint zz", None]
    assert [one(frame, n, report.constraint_name)[0] for n in names] == ["a_b", "d2", "zz", "Unknown"]
    kinds = ["UniqueViolation", "SLAMiss", "Unknown", "other", None]
    assert [one(frame, k, report.severity)[0] for k in kinds] == ["P1", "P2", "P3", "P3", "P3"]


def test_summary_has_26_text_fields(frame):
    reports = frame([("d", "t", "r", 5, RESPONSE.format(INSIGHTS))], KEY + ", incident_id long, response_text string")
    whole = analyse(triggers(frame), evidence(frame), reports)
    status = {r.run_id: (r.workflow_status, r.rca_status, r.errors) for r in whole.collect()}
    assert status == {"r": ("SUCCESS", "SUCCESS", []), "other": ("PARTIAL", "ERROR", ["rca: no stored response"])}
    summary = summarise(whole)
    assert {t for _, t in summary.dtypes[:26]} == {"string"} and summary.columns[25] == "final_verdict"
    row = {r.incident_id: r for r in summary.collect()}["5"]
    assert (row.severity, row.status, row.confidence, row.product_load) == ("P2", "Confirmed", "1.0", "Delayed")
    assert row.postgresql_check == "SLA Miss — 1,000,000 rows being processed. No product lookup required."
    assert row.historical_cases == "7 similar case(s) found — closest: INC052"
    assert (row.remove_duplicate_record, row.rerun_dag) == ("Increase chunk size", "Re-trigger")
    assert row.prevention_high_1 == rules.PREVENTION_PADDING and row.sla_analysis == "a | b | c | d"
    assert (row.rows_inserted, row.total_rows) == (440000, 1000000)
    assert "- Most successful" in row.performance_insights
    assert (row.system_health, row.cpu_health, row.memory_health) == ("CRITICAL", "CRITICAL", "WARNING")


def test_publishable(frame):
    rows = frame([(True, "SUCCESS"), (True, "PARTIAL"), (True, "FAILED"), (False, "SUCCESS")],
                 "has_rca boolean, workflow_status string")
    assert rca.publishable(rows).count() == 2
    crashed = frame([([], True), ([], False), (["e"], False)], "e array<string>, c boolean")
    got = [r[0] for r in crashed.select(rca.incident_status(F.col("e"), F.col("c"))).collect()]
    assert got == ["FAILED", "SUCCESS", "PARTIAL"]


def test_check_outcomes(frame):
    rows = frame([("SLAMiss", 0, None, None, None, None), ("X", 0, True, "n", "SUCCESS", "5"),
                  ("X", 0, False, None, "SUCCESS", None), (None, None, None, None, "ERROR", None)],
                 "t string, n long, e boolean, p string, s string, i string")
    outcome = report.check_outcome(*[F.col(c) for c in "tnepsi"])
    assert [tuple(r) for r in rows.select(*outcome.values()).collect()] == [
        ("SLA_MISS", "SLA Miss — no product lookup required."), ("FOUND", "Product ID 5 exists — n"),
        ("NOT_FOUND", "Product ID None not found in product_master"), ("UNAVAILABLE", "DB check unavailable")]


def test_history_evidence_keeps_queries_without_a_find(frame):
    queries = frame([("q", [0.0], 100), ("none", None, 100)],
                    "query_id string, embedding array<double>, current_volume long")
    chunks = frame([("k1", "1", [0.0], "a"), ("k2", "2", [1.0], "a"), ("k3", "3", [0.0], "b")],
                   "chunk_id string, incident_id string, embedding array<double>, source_dataset string")
    cases = frame([("1", "90", "10"), ("2", "900", "30"), ("3", "1", "1")],
                  "incident_id string, record_volume string, rows_per_second string")
    rows = {r.query_id: r for r in history_evidence(queries, chunks, cases, "a").collect()}
    found, empty = rows["q"], rows["none"]
    assert (found.incidents_found, found.top_match_id, found.has_benchmarks) == (2, "1", True)
    assert (found.benchmark_incident_count, found.avg_rows_per_second, found.volume_matched) == (1, 10.0, True)
    assert (empty.incidents_found, empty.top_match_id, empty.has_benchmarks) == (0, None, False)
    everywhere = {r.query_id: r.incidents_found for r in history_evidence(queries, chunks, cases).collect()}
    assert everywhere == {"q": 3, "none": 0}


def test_host_and_database_evidence_of_sparse_tables(frame):
    samples = frame([("h", 1, 1, 95.0, 10.0), ("h", 2, 2, 10.0, 10.0), ("h", 3, 3, 10.0, 10.0)],
                    "host string, day int, sample_no int, cpu_percent double, ram_used_percent double")
    samples = samples.selectExpr("*", "0D load_avg", "4 cores", "0D iowait_percent", "0D swap_percent", "false oom")
    activity = frame([(2, "WARNING")], "day int, activity_health string")
    rows = host_evidence(samples, activity, "day", "day", [F.col("sample_no")]).orderBy("sample_no").collect()
    assert [(r.postgres_health, r.overall_health) for r in rows] == [
        ("UNKNOWN", "CRITICAL"), ("WARNING", "WARNING"), ("UNKNOWN", "HEALTHY")]

    sessions = frame([(1, 7, "u", "active", "select 1", None, None)],
                     "snapshot_ts int, pid int, usename string, state string, query string, "
                     "query_start timestamp_ntz, xact_start timestamp_ntz")
    sessions = sessions.withColumnRenamed("snapshot_ts", "n").withColumn("snapshot_ts", F.expr("timestamp_ntz'2026-01-01'"))
    locks = frame([(2, 8, "relation", 1, 1, "X", False)],
                  "n int, pid int, locktype string, database long, relation long, mode string, granted boolean")
    counters = frame([(3, 1, 99, 0, 0)], "n int, blks_hit long, blks_read long, deadlocks long, temp_files long")
    rows = database_evidence(sessions, locks, counters, F.lit(10), ["n"]).orderBy("n").collect()
    assert [(r.total_connections, r.waiting_locks_total, r.lock_waits, r.health) for r in rows] == [
        (1, 0, 0, "HEALTHY"), (0, 1, 0, "CRITICAL"), (0, 0, 0, "WARNING")]
    assert rows[0].issues == [] and len(rows[1].issues) == 1
