import json
import os
import re

import pytest
from pyspark.sql import functions as F

from faultline import rules
from faultline.operators import evidence as ev
from faultline.operators import logs
from faultline.plans.log_export import events_of, export_log_events
from faultline.sources import task_logs
from faultline.streaming.logs import stream_log_events

RUN = "manual__2026-06-08T09:17:20.983676+00:00"
TEXT = """lead-in line
[2026-06-08 14:47:22] `INFO` - Read 10 rows source=etl.load loc=load.py:10 tail
  Traceback (most recent call last):

    psycopg2.errors.UniqueViolation: duplicate key
[2026-06-08 14:47:23] `ERROR` - step stopped
not all arguments converted
[2026-06-08 14:47:24] `WARNING` - *** SLA MISS *** launching autorca
[2026-06-08 14:47:25] `WARNING` - slow
[2026-06-08 14:47:26] `INFO` - Exported 5
{"event": "x"}
"""


def write_log(root, text, dag="d", run=RUN, task="t", name="attempt=1.log"):
    folder = os.path.join(root, f"dag_id={dag}", f"run_id={run}", f"task_id={task}")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_log_tree_to_events(spark, tmp_path):
    root = str(tmp_path / "logs")
    write_log(root, TEXT)
    write_log(root, "no header at all\n", run="other", name="attempt=2.log")
    events = events_of(task_logs.read_task_logs(spark, root)).orderBy("timestamp").collect()
    assert [(r.level, r.event_type) for r in events] == [
        ("INFO", "DB_DUPLICATE_KEY"), ("ERROR", "DB_TYPE_ERROR"), ("WARNING", "AUTORCA"),
        ("WARNING", "WARNING"), ("INFO", "EXPORT")]
    first = events[0]
    assert (first.dag_id, first.run_id, first.task_id, first.attempt) == ("d", RUN, "t", "1")
    assert (first.message, first.source, first.loc) == ("Read 10 rows tail", "etl.load", "load.py:10")
    assert first.traceback == (
        "Traceback (most recent call last):\npsycopg2.errors.UniqueViolation: duplicate key")
    assert events[4].traceback == '{"event": "x"}'
    export_log_events(spark, root, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, multiLine=True, escape='"')
    assert back.columns == rules.LOG_EVENT_COLUMNS and back.count() == 5


def test_one_large_log_is_read_by_many_tasks(spark, tmp_path):
    root = str(tmp_path / "logs")
    text = "".join(
        f"[2026-06-08 14:00:00] `INFO` - record {i}\n" + "".join(f"  line {i}.{j}\n" for j in range(i % 4))
        for i in range(2000))
    write_log(root, "lead\n" + text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = task_logs.read_task_logs(spark, root)
        assert lines.select("block").distinct().count() > 5
        rows = events_of(lines).orderBy("record_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.message for r in rows] == [f"record {i}" for i in range(2000)]
    assert [r.traceback for r in rows] == [
        "\n".join(f"line {i}.{j}" for j in range(i % 4)) for i in range(2000)]


def test_json_lines(frame):
    lines = ['{"event": "a b", "level": "error"}', '{"event": "c"}', '{"level": "info"}', "5", "plain",
             "  ", '{"event": broken', "[1]", '{"event": null, "level": null}', '  {"event": "s"}  ']
    rows = task_logs.json_log_lines(frame(list(enumerate(lines)), "i int, line string"))
    assert [r.line for r in rows.orderBy("i").collect()] == [
        "[ERROR] a b", "[INFO] c", "[INFO] ", "5", "plain", '{"event": broken', "[1]", "[INFO] ",
        "[INFO] s"]


EVENTS = [
    ["Task failed\nCaused by: boom product_id=5"],
    ["Task\n\n  failed here\n"],
    ["start", "late\nException:", "\n boom\nat 2026-01-02T03:04:05", "Traceback\n  File x\nKeyError: 1", "end"],
]


def test_every_line_of_a_json_event_is_searched(frame):
    rows = [(i, 0, n, json.dumps({"event": event})) for i, events in enumerate(EVENTS) for n, event in enumerate(events)]
    lines = task_logs.json_log_lines(frame(rows, "log int, block int, line_pos int, line string"))
    assert lines.columns == ["log", "block", "line_pos", "line"]
    got = {r.log: r.asDict() for r in ev.error_evidence(lines, ["log"]).collect()}
    assert len(got) == len(EVENTS)
    for i, events in enumerate(EVENTS):
        text = "\n".join(x for e in events for x in f"[INFO] {e}".split("\n") if x.strip())
        want = plain_evidence(text)
        assert {k: v for k, v in got[i].items() if k != "log"} == want | {"error_message": want["error_message"].strip()}
    assert got[0]["error_message"] == "Caused by: boom product_id=5" and got[0]["product_id"] == "5"


def plain_evidence(text):
    """The evidence of one whole text, found with Python patterns."""
    found = {"error_type": "Unknown", "error_message": "Unknown", "product_id": None, "traceback": "",
             "execution_time": None}
    for phrase, name in rules.ERROR_PHRASES:
        if phrase.lower() in text.lower():
            found["error_type"] = name
            break
    hits = [re.search(p, text, re.I) for p in rules.ERROR_MESSAGE_PATTERNS]
    words = [r for r in text.split("\n") if any(w in r.lower() for w in rules.ERROR_LINE_WORDS)]
    hit = next((h for h in hits if h), None)
    if hit:
        found["error_message"] = hit.group(0).strip()[:300]
    elif words:
        found["error_message"] = words[0]
    ids = [re.search(p, text, re.I) for p in rules.PRODUCT_ID_PATTERNS]
    found["product_id"] = next((h.group(1) for h in ids if h), None)
    if "Traceback" in text:
        found["traceback"] = text[text.index("Traceback"):][:2000]
    stamp = re.search(rules.ISO_TIMESTAMP_PATTERN, text)
    found["execution_time"] = stamp.group(1) if stamp else None
    return found


LOGS = [
    "all fine",
    "KeyException: boom\nother Exception: late",
    "x Exception:\nnext line\nCaused by: y",
    "a\nException:",
    "Caused by:\nException: z",
    "first ERROR - one\nsecond error here -\nthree",
    "ERROR only\n- dash below",
    "a failed thing\nviolation",
    "product_id\n= 12\nproduct_id: 13",
    'Key (product_id)=(77) dup\n"product_id": 5',
    "product_id)=(9)\nProduct_ID = 4",
    "q Traceback here\n" + "\n".join("z" * (i % 50 + 1) for i in range(300)),
    "Traceback\n" + "\n".join("a" for _ in range(1500)),
    "at 2026-01-02T03:04:05Z and 2027-01-01T00:00:00",
    "SLA threshold: 30s\nduplicate key value violates",
    "Exception: " + "m" * 400,
]


@pytest.mark.parametrize("block_lines", [1, 3, 10_000])
def test_evidence_equals_whole_text_search(frame, block_lines):
    rows = [(i, n // block_lines, n, line) for i, text in enumerate(LOGS)
            for n, line in enumerate(text.split("\n"))]
    got = ev.error_evidence(frame(rows, "log int, block int, line_pos int, line string"), ["log"])
    for row in got.collect():
        assert {k: row[k] for k in row.asDict() if k != "log"} == plain_evidence(LOGS[row.log]), row.log


def test_log_choice_and_evidence(spark, tmp_path, frame):
    root = str(tmp_path / "logs")
    for path, stamp in [
        (write_log(root, "old Exception: a\n", run="r1"), 1), 
        (write_log(root, "Exception: b\n", run="r1", name="attempt=2.log"), 2),
        (write_log(root, "Exception: c product_id=8\n", run="r2"), 3),
        (write_log(root, "x\n", dag="e", run="r", task="u", name="solo-extra.log"), 4),
    ]:
        os.utime(path, (1_700_000_000 + stamp, 1_700_000_000 + stamp))
    lines = task_logs.json_log_lines(task_logs.read_task_logs(spark, root))
    triggers = frame([("d", "t", "r1", ""), ("d", "t", "zz", ""), ("d", "solo", "q", ""),
                      ("d", "none", "q", ""), ("d", "t", "sla_miss", "2026")],
                     "dag_id string, task_id string, run_id string, execution_date string")
    files = ev.latest_log(lines.select("path", "dag_id", "run_id", "task_id", "modified"), triggers)
    tiers = {(r.task_id, r.run_id): (r.tier, r.path and r.path.rsplit("/", 1)[1]) for r in files.collect()}
    assert tiers[("t", "r1")] == (1, "attempt=2.log") and tiers[("t", "zz")] == (2, "attempt=1.log")
    assert tiers[("solo", "q")] == (3, "solo-extra.log") and tiers[("none", "q")] == (None, None)
    got = {(r.task_id, r.run_id): r for r in ev.log_evidence(triggers, lines).collect()}
    assert len(got) == 5
    assert got[("t", "r1")].error_message == "Exception: b"
    assert got[("t", "zz")].product_id == "8"
    assert got[("none", "q")].error_message == "No log content available"
    assert got[("none", "q")].error_type == "Unknown" and not got[("none", "q")].log_found
    sla = got[("t", "sla_miss")]
    assert sla.error_type == "SLAMiss" and sla.execution_time == "2026" and sla.error_message.startswith("Task 't' in DAG 'd'")


def test_oom(frame):
    rows = frame([("a", "Out of memory: kill"), ("a", "x oom-killer y"), ("b", "out of memory")],
                 "h string, line string")
    got = {r.h: (r.oom_count, r.oom_detected) for r in logs.oom_events(rows, ["h"]).collect()}
    assert got == {"a": (2, True), "b": (0, False)}


def test_event_rules(frame):
    cases = [("SLA Miss Detected", "", "INFO", "SLA_MISS"), ("FAILURE DETECTED autorca", "", "", "FAILURE_TRIGGER"),
             ("task failed", "UniqueViolation", "", "TASK_ERROR"), ("x", "", "ERROR", "ERROR"),
             ("Task instance is in running", "", "", "TASK_START"), ("task instance in failure", "", "", "TASK_END_FAILURE"),
             ("inserted", "", "ERROR", "INSERT_SUCCESS"), ("read", "", "INFO", "INFO"), ("rows read", "", "", "DATA_READ")]
    rows = frame(cases, "m string, t string, l string, want string")
    for row in rows.withColumn("got", logs.event_type(F.col("m"), F.col("t"), F.col("l"))).collect():
        assert row.got == row.want


def test_streamed_logs_equal_batch(spark, tmp_path):
    root = str(tmp_path / "logs")
    write_log(root, TEXT)
    batch = sorted(map(tuple, events_of(task_logs.read_task_logs(spark, root)).select(
        *rules.LOG_EVENT_COLUMNS).collect()))
    out, check = str(tmp_path / "rows"), str(tmp_path / "check")

    def run():
        stream_log_events(spark, root, out, check, {"availableNow": True}).awaitTermination(60)
        return sorted(map(tuple, spark.read.parquet(out).select(*rules.LOG_EVENT_COLUMNS).collect()))

    assert run() == batch
    write_log(root, TEXT, run="later")
    assert len(run()) == 2 * len(batch)


def test_text_after_a_json_object_is_no_json(frame):
    rows = task_logs.json_log_lines(frame([('{"event": "x"} tail',)], "line string"))
    assert [r.line for r in rows.collect()] == ['{"event": "x"} tail']
