"""The driver contract, and every query with SQL on the smallest shared tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables are not here")


def canonical(rows, columns):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in places) for row in rows)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        if name.endswith(".parquet"):
            connection.execute(f"create view {name[:-8]} as select * from '{FOLDER}/{name}'")
    return connection


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_every_operator_of_the_inventory_is_shown():
    wanted = (
        [f"SRC-0{i}" for i in range(1, 9)] + [f"SNK-0{i}" for i in range(1, 8)]
        + [f"PRJ-{i:02}" for i in (1, 2, 3, 4, 6, 7, 8, 10, 11, 12, 13, 15, 16, 17, 18)]
        + [f"FIL-{i:02}" for i in range(1, 11)] + [f"JON-{i:02}" for i in range(1, 11)]
        + [f"AGG-{i:02}" for i in range(1, 17)] + [f"WIN-{i:02}" for i in range(1, 13)]
        + [f"SRT-0{i}" for i in range(1, 6)] + [f"SET-0{i}" for i in range(1, 4)]
        + [f"LOG-0{i}" for i in range(1, 10)] + [f"HLT-0{i}" for i in range(1, 6)]
        + [f"RCA-0{i}" for i in range(1, 6)] + [f"RPT-0{i}" for i in (1, 2, 4, 6, 7)]
        + [f"STR-0{i}" for i in range(1, 6)]
    )
    shown = {o for ids in entry.operators().values() for o in ids}
    assert set(wanted) <= shown, sorted(set(wanted) - shown)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    result = entry.queries()[name](spark, FOLDER)
    got = canonical([tuple(r) for r in result.collect()], result.columns)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    assert got == canonical(cursor.fetchall(), columns)
