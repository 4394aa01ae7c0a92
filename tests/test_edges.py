"""Rows that used to be lost or changed in silence."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindings import rca as bound
from faultline import rules
from faultline.operators import benchmarks, rca, sinks
from faultline.operators.evidence import error_evidence, log_evidence
from faultline.plans import load
from faultline.plans.incident import analyse
from faultline.sources.incidents import read_incidents
from faultline.sources.task_logs import read_task_logs
from faultline.streaming.load import loaded


def test_csv_keeps_blanks_and_line_ends(spark, tmp_path):
    cells = ["  lead", "trail  ", '"quoted" ', "two\n  lines \n", "a,b"]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, text string")
    assert sinks.export_csv(df, str(tmp_path / "out")) == len(cells)
    back = spark.read.csv(
        str(tmp_path / "out"), header=True, escape='"', multiLine=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    assert sorted(r["text"] for r in back.collect()) == sorted(cells)


def test_means_beyond_64_bits(spark):
    df = spark.createDataFrame([(2e13,), (2e13,), (-1.0,)], "v double")
    mean = df.agg(benchmarks._mean(F.col("v"), F.lit(True))).first()[0]
    assert mean == 2e13


def test_triggers_without_a_run_are_kept(spark):
    triggers = spark.createDataFrame(
        [("d", "t", None, None), ("d", "t", rules.SLA_RUN_ID, None), ("d", "x" * 300, "r", None)],
        "dag_id string, task_id string, run_id string, execution_date string",
    )
    logs = spark.createDataFrame(
        [("/d/t.log", "d", "r1", "t", 1, 0, 0, "ERROR - it broke")],
        "path string, dag_id string, run_id string, task_id string, modified bigint, block bigint, "
        "line_pos bigint, line string",
    )
    assert log_evidence(triggers, logs).count() == 3


def test_reading_a_load_leaves_the_schema_alone(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType())])
    spark.range(3).withColumn("batch_id", F.lit(0)).write.partitionBy("batch_id").parquet(str(tmp_path / "t"))
    assert loaded(spark, str(tmp_path / "t"), schema).columns == ["id"]
    assert schema.names == ["id"]


PRODUCT = ',"a",c,b,,r,s,g,S1,sn,{},2.50,0.1,3,4,4.5,6,active,2024-01-05'


def product_csv(path, rows):
    header = ",".join(c.split()[0] for c in rules.PRODUCT_SCHEMA.split(", "))
    path.write_text("\n".join([header] + [str(key) + PRODUCT.format(price) for key, price in rows]) + "\n")
    return str(path)


def test_rejected_products_are_kept_and_counted(spark, tmp_path):
    rows = [(1, "1.5"), ("2x", "1.5"), (3, "abc"), ("", "2.0"), (4, "2.0"), (4, "3.0")]
    target = str(tmp_path / "table")
    assert load.load_products(spark, product_csv(tmp_path / "p.csv", rows), target).count() == 2
    refused = load.rejected_products(spark, target).collect()
    assert sorted(r.reason for r in refused) == ["malformed", "malformed", "no key"]
    assert sorted(r.bad_row[:2] for r in refused if r.bad_row) == ["2x", "3,"]


def test_a_load_leaves_the_other_loads_alone(spark, tmp_path):
    target = tmp_path / "table"
    load.load_products(spark, product_csv(tmp_path / "p.csv", [(1, "1.5"), (2, "1.5")]), str(target), "a")
    before = {f: f.stat().st_mtime_ns for f in target.rglob("*.parquet") if f.is_file()}
    second = product_csv(tmp_path / "q.csv", [(2, "9.5"), (3, "1.5")])
    for _ in range(2):
        rows = load.load_products(spark, second, str(target), "b").collect()
        assert sorted((r.product_id, str(r.cost_price)) for r in rows) == [(1, "1.50"), (2, "1.50"), (3, "1.50")]
    assert all(f.stat().st_mtime_ns == at for f, at in before.items())
    assert load.rejected_products(spark, str(target)) is None


@pytest.mark.parametrize("header", ["a,b", "a,a", "a,"])
def test_incident_records_with_too_many_cells_fail(spark, tmp_path, header):
    path = tmp_path / "i.csv"
    path.write_text(f'{header}\n1,"x, ""y"", z"\n2\n3,\n')
    assert [tuple(r)[:2] for r in read_incidents(spark, str(path)).orderBy("input_pos").collect()] == [
        ("1", 'x, "y", z'), ("2", ""), ("3", "")]
    path.write_text(f"{header}\n1,2\n1,,3\n")
    with pytest.raises(Exception, match="more cells"):
        read_incidents(spark, str(path)).select("input_pos").collect()


@pytest.mark.parametrize("header, other", [("x,y", "y,x"), ("x,y", "x,y,z"), ("x,x", "x,y")])
def test_incident_files_of_differing_headers_fail(spark, tmp_path, header, other):
    (tmp_path / "a.csv").write_text(f"{header}\n1,2\n")
    (tmp_path / "b.csv").write_text(f"{header}\n3,4\n")
    assert read_incidents(spark, str(tmp_path)).count() == 2
    (tmp_path / "b.csv").write_text(f"{other}\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_incidents(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("lines_of_a_block", [1, 2, 9])
def test_a_match_over_three_lines(spark, lines_of_a_block):
    lines = ["x", "product_id", "=", "5", "end"]
    rows = [("log", n // lines_of_a_block, n, line) for n, line in enumerate(lines)]
    found = error_evidence(spark.createDataFrame(rows, "path string, block int, line_pos int, line string"), ["path"])
    assert found.first()["product_id"] == "5"


def test_raw_json_lines_are_cleaned(spark):
    triggers = spark.createDataFrame(
        [("d", "t", "r", None)], "dag_id string, task_id string, run_id string, execution_date string"
    )
    logs = spark.createDataFrame(
        [("/d/t.log", "d", "r", "t", 1, 0, 0, '  {"level": "error", "event": "Exception: boom"}')],
        "path string, dag_id string, run_id string, task_id string, modified bigint, block bigint, "
        "line_pos bigint, line string",
    )
    assert log_evidence(triggers, logs).first()["error_message"] == "Exception: boom"


def test_only_the_folders_asked_for_are_read(spark, tmp_path):
    for run in ("r1", "r2"):
        folder = tmp_path / "dag_id=d" / f"run_id={run}" / "task_id=007"
        folder.mkdir(parents=True)
        (folder / "attempt=1.log").write_text(f"in {run}\n")
    rows = read_task_logs(spark, str(tmp_path), run_id="r2", task_id="007")
    assert [(r.run_id, r.task_id, r.attempt, r.line) for r in rows.collect()] == [("r2", "007", "1", "in r2")]
    assert len(rows.inputFiles()) == 2  # what the table has; the plan prunes it
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_a_crash_fails_the_incident(spark):
    triggers = spark.createDataFrame(
        [("d", "t", "r1", True), ("d", "t", "r2", None)], "dag_id string, task_id string, run_id string, crashed boolean"
    )
    keys = ["dag_id", "task_id", "run_id"]
    ok = triggers.select(*keys, F.lit("SUCCESS").alias("status"))
    evidence = {
        "log": (ok.withColumns({"error_type": F.lit("x"), "product_id": F.lit("1")}), keys),
        "audit": (ok.withColumn("error_message", F.lit("")), keys),
        "product": (ok.withColumn("exists", F.lit(True)), keys),
        "history": (ok.withColumns({"incidents_found": F.lit(1), "has_benchmarks": F.lit(True)}), keys),
        "host": (ok.withColumn("overall_health", F.lit("HEALTHY")), keys),
        "runtime": (ok.withColumns({"health": F.lit("HEALTHY"), "has_counters": F.lit(True)}), keys),
        "perf": (ok.select(*keys, F.lit(1).alias("rows_inserted"), F.lit(2).alias("total_rows")), keys),
    }
    reports = triggers.select(*keys, F.lit(1).alias("incident_id"), F.lit("<summary>s</summary>").alias("response_text"))
    done = analyse(triggers, evidence, reports)
    assert {r.run_id: r.workflow_status for r in done.collect()} == {"r1": "FAILED", "r2": "SUCCESS"}
    assert [r.run_id for r in rca.publishable(done).collect()] == ["r2"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="shared tables are not here")
def test_scores_read_evidence_and_not_the_events(spark):
    scores = bound.confidence_scores(spark, "/root/testdata/sf0.001")
    read = {os.path.basename(f) if "/testdata/" in f else f.split("/")[-2] for f in scores.inputFiles()}
    assert "events.parquet" not in read
    assert {"log", "audit", "product", "history", "host", "runtime", "perf"} <= read
