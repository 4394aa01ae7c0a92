import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from faultline import rules
from faultline.operators import cases as c
from faultline.operators import chunks as ch
from faultline.operators import sinks
from faultline.plans.ingest import ingest, prepare
from faultline.sources import tables
from faultline.sources.incidents import POSITION, read_incidents

CSV = (
    "﻿Ticket ID,Note,note,A b,a-B,,Root  Cause,Status\r\n"
    'T1,"line one\nline ""two""",x,NA,null,z, spaced\t out ,open\r\n'
    'T1,"line one\nline ""two""",x,NA,null,z, spaced\t out ,open\r\n'
    "T1,second,,b,,,other cause,open\r\n"
    ",no id,,,,,lost,\r\n"
    "   ,blank id,,,,,lost,\r\n"
    "T2,third,,,,,é cause,closed\r\n"
)


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "incidents.csv"
    path.write_bytes(CSV.encode("utf-8"))
    return str(path)


def test_names():
    assert c.unique_names([c.snake_name(n) for n in ["A b", "a-B", ""]]) == ["a_b", "a_b_2", "column"]
    assert c.unique_names(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]
    assert c.snake_name("__Größe (mm)__") == "gr_e_mm"


def test_read_incidents(spark, csv_path):
    raw = read_incidents(spark, csv_path)
    named, mapping = c.normalize_columns(raw)
    assert named.columns == [
        "ticket_id", "note", "note_2", "a_b", "a_b_2", "column", "root_cause", "status", POSITION]
    rows = named.orderBy(POSITION).collect()
    assert len(rows) == 6
    assert rows[0].note == 'line one\nline "two"' and rows[0].a_b == "NA" and rows[0].a_b_2 == "null"
    assert rows[2].note_2 == "" and rows[0].ticket_id == "T1"
    assert mapping["Root  Cause"] == "root_cause"
    assert sorted(mapping.values()) == sorted(c.source_columns(named))


def test_mapping_keeps_equal_headers(frame):
    named, mapping = c.normalize_columns(frame([("1", "2", "3", "4")], "a string, b string, c string, d string").toDF(
        "Note", "Note", "Note_2", "x"))
    assert named.columns == ["note", "note_3", "note_2", "x"]
    assert mapping == {"Note": "note", "Note_3": "note_3", "Note_2": "note_2", "x": "x"}


def test_ingest_balances_and_merges(spark, csv_path, tmp_path):
    paths = [str(tmp_path / n) for n in ("cases", "chunks", "stage")]
    stats = ingest(spark, csv_path, *paths).collect()[0]
    assert stats.raw_rows == 6 and stats.raw_columns == 8
    assert stats.exact_duplicate_rows_removed == 1
    assert stats.generated_case_ids == 2 and stats.duplicate_case_ids_merged == 1
    assert stats.raw_rows - stats.exact_duplicate_rows_removed - stats.duplicate_case_ids_merged == (
        stats.final_case_rows) == 4
    stored = {r.incident_id: r for r in tables.read_cases(spark, paths[0]).collect()}
    merged = stored["T1"]
    assert merged.note == 'line one\nline "two"\n\nsecond'
    assert merged.root_cause == "spaced out\n\nother cause"
    assert merged.status == "open" and merged.a_b_2 == "null"
    assert [r["note"] for r in json.loads(merged.raw_fields_json)] == ['line one\nline "two"', "second"]
    assert merged.comment_length == len(merged.case_document)
    assert merged.case_document == (
        "Incident ID: T1\n\nIncident Id: T1\nTicket Id: T1\nStatus: open\n"
        "Root Cause:\nspaced out\n\nother cause\n\n"
        'Note:\nline one\nline "two"\n\nsecond\n\nNote 2: x\nA B:\nNA\n\nb\n\nA B 2: null\nColumn: z')
    chunks = tables.read_chunks(spark, paths[1], rules.SOURCE_DATASET)
    assert tables.chunk_count(chunks).first().chunk_count == stats.chunks_created == 4
    data = {r.incident_id: r.metadata for r in chunks.collect()}["T1"]
    assert data["status"] == "open" and data["chunk_index"] == "0" and "ticket_id" in data
    again = ingest(spark, csv_path, *paths, reset=False).collect()[0]
    assert again == stats
    assert tables.read_chunks(spark, paths[1], rules.SOURCE_DATASET).count() == 4


def test_generated_ids_do_not_depend_on_order(frame):
    rows = [("", "a", 1), ("", "b", 2)]
    first = prepare(frame(rows, f"id string, t string, {POSITION} long"))
    second = prepare(frame(rows[::-1], f"id string, t string, {POSITION} long"))
    ids = [sorted(r.incident_id for r in p.merged.collect()) for p in (first, second)]
    assert ids[0] == ids[1] and all(i.startswith("GENERATED_CASE_") and len(i) == 31 for i in ids[0])


def test_merge_keeps_first_seen_order_and_first_position(frame):
    rows = [("k", "b", "", 2), ("k", "a", "", 1), ("k", "b", "", 3), ("s", "q", "w", 4)]
    merged = c.merge_cases(frame(rows, f"incident_id string, v string, e string, {POSITION} long"))
    got = {r.incident_id: (r.v, r.e, r[POSITION]) for r in merged.collect()}
    assert got == {"k": ("a\n\nb", "", 1), "s": ("q", "w", 4)}


def test_displaced_incident_id(frame):
    df = frame([("i", "c", "s")], "incident_id string, case_id string, source_original_incident_id string")
    row = c.assign_case_id(df, df.columns, "case_id", {}).first()
    assert row.incident_id == "c" and row.source_original_incident_id_2 == "i"


def test_choose_case_id(frame):
    df = frame([("", "x", " ")], "id string, ticket_id string, case_id string")
    assert c.choose_case_id(df) == "ticket_id"
    assert c.choose_case_id(df, "ID") == "id"
    assert c.choose_case_id(frame([("a",)], "z string")) is None


def chunk_rule(text, size, overlap):
    if len(text) <= size:
        return [text]
    starts = range(0, len(text), size - overlap)
    return [p for p in (text[s:s + size].strip() for s in starts) if p]


@pytest.mark.parametrize("size,overlap", [(1200, 200), (10, 7), (10, 0), (7, 6)])
def test_chunks_follow_the_rule(frame, size, overlap):
    texts = ["x" * 2100, "short", "", "abc é 漢字 😀 def ghi jkl mno pqr", "a" * 10, "a b " * 20, "w" * 11]
    texts = [t.strip() for t in texts]
    got = ch.chunk_documents(
        frame(list(enumerate(texts)), "k int, t string"), size, overlap, "t", "k"
    ).orderBy("k", "chunk_index").collect()
    for i, text in enumerate(texts):
        rows = [r for r in got if r.k == i]
        assert [r.chunk_text for r in rows] == chunk_rule(text, size, overlap)
        assert [r.chunk_id for r in rows] == [f"{i}_chunk_{n}" for n in range(len(rows))]
        assert {r.total_chunks for r in rows} == {len(rows)}


def test_chunk_lengths_of_the_fixture(frame):
    rows = ch.chunk_documents(frame([(1, "y" * 2100)], "k int, t string"), document="t", key="k")
    assert [len(r.chunk_text) for r in rows.orderBy("chunk_index").collect()] == [1200, 1100, 100]
    with pytest.raises(ValueError):
        ch.chunk_documents(rows, 200, 200)


def test_chunking_does_not_shuffle(frame):
    plan = ch.chunk_documents(frame([(1, "y")], "k int, t string"), document="t", key="k")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_metadata_columns():
    columns = ["zeta", "status", "my_type", "priority", "raw_fields_json", "source_dataset", "x"]
    assert ch.metadata_columns(columns) == ["priority", "status", "my_type"]
    assert ch.metadata_columns(columns, "X, nope,Zeta") == ["x", "zeta"]
    assert len(ch.metadata_columns([f"id_{i}" for i in range(50)])) == 20


def test_upsert_is_idempotent(frame):
    old = frame([("a", 1), ("b", 1)], "chunk_id string, v int")
    new = frame([("b", 2), ("c", 2)], "chunk_id string, v int")
    once = sinks.upsert_chunks(old, new)
    twice = sinks.upsert_chunks(once, new)
    rows = sorted(tuple(r) for r in once.collect())
    assert rows == [("a", 1), ("b", 2), ("c", 2)] == sorted(tuple(r) for r in twice.collect())


def test_replace_source_modes(frame):
    schema = "chunk_id string, source_dataset string"
    old = frame([("1", "a"), ("2", "a"), ("3", "b")], schema)
    new = frame([("2", "a"), ("9", "a")], schema)

    def ids(**modes):
        return sorted(r.chunk_id for r in sinks.replace_source(old, new, **modes).collect())

    assert ids() == ["2", "9"]
    assert ids(reset=False) == ["2", "3", "9"]
    assert ids(reset=False, replace=False) == ["1", "2", "3", "9"]


def test_insert_if_absent(frame):
    target = frame([(1, "old")], "k int, v string")
    batch = frame([(1, "new", 1), (2, "first", 2), (2, "second", 3), (None, "x", 4)],
                  "k int, v string, pos int")
    fresh = sinks.insert_absent(target, batch, "k", [F.col("pos")]).drop("pos")
    assert [tuple(r) for r in fresh.collect()] == [(2, "first")]
    full = target.unionByName(fresh)
    assert sinks.insert_absent(full, batch, "k", [F.col("pos")]).count() == 0


def test_case_store_is_replaced(spark, frame, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(AnalysisException):
        tables.read_cases(spark, path)
    for rows in ([(1,), (2,)], [(2,), (3,)]):
        sinks.write_cases(frame(rows, "a int"), path)
        assert sorted(r.a for r in tables.read_cases(spark, path).collect()) == [r[0] for r in rows]


def test_append_rca_ids(frame):
    repo = frame([(7,)], "incident_id long")
    reports = frame(
        [("d", "t", None, "i", "r", None, s, d, n) for n, (s, d) in enumerate(
            [("0.8 | high", 1), (None, 1), ("bad", 2), ("0.25", 2)])],
        "dag_id string, task_id string, root_cause string, business_impact string, resolution string, "
        "preventive_actions string, confidence_score string, day int, created_ts int")
    rows = sinks.append_rca(repo, reports, "day", [F.col("created_ts")]).orderBy("incident_id").collect()
    assert [r.incident_id for r in rows] == [8, 9, 10, 11]
    assert [r.confidence_score for r in rows] == [0.8, 0.5, None, 0.25]
    empty = sinks.append_rca(repo.where("false"), reports, "day", [F.col("created_ts")])
    assert sorted(r.incident_id for r in empty.collect()) == [1, 2, 3, 4]


def test_expand_case(frame):
    df = frame([("a", None, '{"x": "1"}', '["x"]', '{"X": "x"}', 3), ("b", "t", "no json", None, "[", 4)],
               "incident_id string, title string, raw_fields_json string, source_schema_json string, "
               "source_column_mapping_json string, n int")
    first, second = c.expand_case(df).orderBy("incident_id").collect()
    assert first.title == "" and first.n == 3
    assert first.raw_fields == [{"x": "1"}] and first.source_schema == ["x"]
    assert first.source_column_mapping == {"X": "x"}
    assert second.source_schema == [] and second.source_column_mapping == {}
