"""Log lines worked on where they were read, and logs chosen without opening the others."""

import os

import pytest
from pyspark.sql import functions as F

from faultline import rules
from faultline.operators import evidence as ev
from faultline.operators import splits
from faultline.plans.log_export import events_of, file_events
from faultline.sources import task_logs
from tests.test_logs import write_log


@pytest.fixture(params=[60, 400, 1 << 20])
def small_splits(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def long_log(n):
    """Records that span several splits, blank lines, a lead, and lines of one letter."""
    out = ["lead", "  ", "lead two"]
    for i in range(n):
        out.append(f"[2026-06-08 14:00:0{i % 10}] `INFO` - record {i}")
        out += ["", *(f"  line {i}.{j}" for j in range((0, 1, 25, 3)[i % 4]))]
        out += ["Exception: x", "y"] if i == n // 2 else []
        out += ["Traceback (most recent call last):", " a", "product_id", "=", "77"] if i == n // 2 + 1 else []
    return "\n".join(out) + "\n"


def test_next_lines_cross_splits(spark, tmp_path, small_splits):
    root = str(tmp_path / "logs")
    texts = [f"l{i}" + "x" * (i % 37) for i in range(300)]
    write_log(root, "\n".join(texts) + "\n")
    write_log(root, "only\n", run="other")
    lines = task_logs.read_task_logs(spark, root)
    got = splits.chained_lines(lines).orderBy("path", "block", "line_pos").collect()
    many = [(r.line, r.next_line, r.third_line) for r in got if r.line != "only"]
    assert many == [(t, *(texts + [None, None])[i + 1 : i + 3]) for i, t in enumerate(texts)]
    assert [(r.next_line, r.third_line) for r in got if r.line == "only"] == [(None, None)]


def test_folded_records_cross_splits(spark, tmp_path, small_splits):
    root = str(tmp_path / "logs")
    write_log(root, long_log(40))
    write_log(root, "no header\nat all\n", run="headless")
    write_log(root, "[2026-06-08 14:00:00] `INFO` - single\n", run="single")
    lines = task_logs.read_task_logs(spark, root)
    columns = ["run_id", *rules.LOG_EVENT_COLUMNS]
    want = sorted(map(tuple, events_of(lines).select(*dict.fromkeys(columns)).collect()))
    assert len(want) == 41
    for staged in (None, str(tmp_path / "staged")):
        got = file_events(lines, staged).select(*dict.fromkeys(columns))
        assert sorted(map(tuple, got.collect())) == want
    plan = file_events(lines)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_error_evidence_in_place(spark, tmp_path, small_splits):
    root = str(tmp_path / "logs")
    write_log(root, long_log(40))
    write_log(root, "\n".join(f"quiet {i}" for i in range(50)), run="quiet")
    lines = task_logs.json_log_lines(task_logs.read_task_logs(spark, root))
    want, got = (
        sorted(map(tuple, ev.error_evidence(lines, ["path"], in_place=p).select(
            "path", "error_type", "error_message", "product_id", "traceback", "execution_time").collect()))
        for p in (False, True)
    )
    assert got == want and want[0][3] == "77"


def test_files_that_are_not_chosen_stay_closed(spark, frame, tmp_path):
    root = str(tmp_path / "logs")
    write_log(root, "Exception: asked for\n", run="r{1}")
    broken = write_log(root, "no gzip file", run="r2", name="attempt=1.log.gz")
    assert os.path.exists(broken)
    triggers = frame(
        [("d", "t", "r{1}", ""), ("d", "none", "q", ""), ("d", "t", "sla_miss", "2026")],
        "dag_id string, task_id string, run_id string, execution_date string",
    )
    rows = {(r.task_id, r.run_id): r for r in ev.tree_log_evidence(spark, triggers, root).collect()}
    assert len(rows) == 3 and rows[("t", "r{1}")].error_message == "Exception: asked for"
    assert not rows[("none", "q")].log_found and rows[("t", "sla_miss")].error_type == "SLAMiss"
    with pytest.raises(Exception, match="(?i)gzip"):
        task_logs.read_task_logs(spark, root).agg(F.count("line")).collect()


def test_a_list_of_files_tells_what_lines_tell(spark, tmp_path):
    root = str(tmp_path / "logs")
    write_log(root, "a\nb\n", run="manual__2024-01-02T00%3A00%3A00+00%3A00")
    listed = task_logs.list_task_logs(spark, root)
    lines = task_logs.read_task_logs(spark, root)
    identity = ["path", "dag_id", "run_id", "task_id", "attempt", "modified"]
    assert listed.select(*identity).collect() == lines.select(*identity).distinct().collect()
    assert listed.first().run_id == "manual__2024-01-02T00:00:00+00:00" and listed.first().bytes == 4
    again = task_logs.read_log_files(spark, [listed.first().path])
    assert [r.line for r in again.collect()] == ["a", "b"]
    assert task_logs.read_log_files(spark, []).count() == 0


def test_no_lines(spark):
    lines = task_logs.read_log_files(spark, [])
    assert splits.chained_lines(lines).count() == 0
    assert splits.fold_lines(lines, ["path"], F.col("line") == "").count() == 0
