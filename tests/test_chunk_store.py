"""The chunk store against the plain set operations, and which files its writes leave alone."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import chunk_store, sinks
from faultline.sources import tables

SCHEMA = "chunk_id string, chunk_text string, source_dataset string"
COLUMNS = ["chunk_id", "chunk_text", "source_dataset"]
MERGE = {"reset": False, "replace": False}
REPLACE = {"reset": False}


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def files(path):
    """Data files by partition."""
    found = {}
    for file in (path / "rows").glob("*/*/*.parquet"):
        found.setdefault((file.parent.parent.name, file.parent.name), set()).add(file.name)
    return found


def bucket_of(spark, chunk_id, buckets):
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(chunk_id)), F.lit(buckets))).first()[0]


@pytest.mark.parametrize("buckets", [1, 5])
def test_writes_equal_the_set_operations(frame, spark, tmp_path, buckets):
    first = [("a1", "x", "a"), ("a2", "x", "a"), ("b1", "x", "b"), ("c1", "x", "c"), ("n1", "x", None)]
    cases = [
        ([("a1", "y", "a")], REPLACE),
        ([("a1", "y", "a"), ("d1", "y", "d")], MERGE),
        ([("a1", "y", "b")], MERGE),  # a1 moves
        ([("c1", "y", "b")], MERGE),  # nothing is left of c
        ([("n1", "y", None), ("n2", "y", None)], MERGE),
        ([("n2", "y", None)], REPLACE),
        ([(None, "y", "a"), (None, "z", "a")], MERGE),
        ([], REPLACE),
        ([], MERGE),
        ([("z1", "y", "z")], {"reset": True}),
        ([], {"reset": True}),
    ]
    for i, (new, modes) in enumerate(cases):
        path = str(tmp_path / str(i))
        chunk_store.write_chunks(frame(first, SCHEMA), path, buckets=buckets, **modes)
        want = rows(sinks.replace_source(frame(first, SCHEMA), frame(new, SCHEMA), **modes))
        chunk_store.write_chunks(frame(new, SCHEMA), path, **modes)
        assert rows(chunk_store.read_store(spark, path)) == want, (new, modes)


def test_many_writes_in_turn(frame, spark, tmp_path):
    rng = random.Random(3)
    path, held = str(tmp_path / "store"), []
    for step in range(6):
        ids = rng.sample(range(30), rng.randint(1, 12))
        new = [(f"c{i}", f"t{step}", rng.choice("abc")) for i in ids]
        modes = {} if not step else rng.choice([MERGE, MERGE, REPLACE])
        if not step:
            held = new
        elif modes is MERGE:
            held = [r for r in held if r[0] not in {n[0] for n in new}] + new
        else:
            held = [r for r in held if r[2] not in {n[2] for n in new}] + new
        for _ in range(2 if step == 3 else 1):  # a repeated write changes nothing
            chunk_store.write_chunks(frame(new, SCHEMA), path, buckets=4, **modes)
        assert rows(chunk_store.read_store(spark, path)) == sorted(held, key=str)


def test_a_merge_opens_and_rewrites_its_buckets_only(frame, spark, tmp_path):
    path = tmp_path / "store"
    first = [(f"c{i}", "x", "ab"[i % 2]) for i in range(200)]
    chunk_store.write_chunks(frame(first, SCHEMA), str(path), buckets=16)
    before = files(path)
    assert len(before) == 32
    new = [("c7", "y", "b"), ("c8", "y", "b")]
    touched = {("source_dataset=b", f"chunk_bucket={bucket_of(spark, 'c7', 16)}")}
    touched |= {(f"source_dataset={d}", f"chunk_bucket={bucket_of(spark, 'c8', 16)}") for d in "ab"}
    buckets = {bucket for _, bucket in touched}
    kept_bytes = {}
    for place, names in before.items():
        if place[1] not in buckets:
            for name in names:  # the merge must not open these
                file = path / "rows" / place[0] / place[1] / name
                kept_bytes[file] = file.read_bytes()
                file.write_bytes(b"no parquet")
    chunk_store.write_chunks(frame(new, SCHEMA), str(path), **MERGE)
    after = files(path)
    assert {place for place in before if before[place] != after[place]} == touched
    for file, content in kept_bytes.items():
        file.write_bytes(content)
    want = [r for r in first if r[0] not in ("c7", "c8")] + new
    assert rows(chunk_store.read_store(spark, str(path))) == sorted(want)


def test_replacing_leaves_other_datasets(frame, spark, tmp_path):
    path = tmp_path / "store"
    first = [(f"c{i}", "x", "ab"[i % 2]) for i in range(100)]
    chunk_store.write_chunks(frame(first, SCHEMA), str(path), buckets=8)
    before = files(path)
    chunk_store.write_chunks(frame([("n", "y", "a")], SCHEMA), str(path), **REPLACE)
    after = files(path)
    changed = {place for place in before if before[place] != after[place]}
    assert changed == {place for place in before if place[0] == "source_dataset=a"}
    assert rows(tables.read_chunks(spark, str(path), "a")) == [("n", "y", "a")]
    assert tables.chunk_count(tables.read_chunks(spark, str(path), "b")).first()[0] == 50


def test_columns_types_and_names(frame, spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        chunk_store.read_store(spark, path)
    chunk_store.write_chunks(frame([("a", "x", ""), ("b", "x", "d")], SCHEMA), path, buckets=3)
    wider = frame([("b", "y", "d", 5)], f"{SCHEMA}, n int")
    chunk_store.write_chunks(wider, path, **MERGE)
    got = chunk_store.read_store(spark, path).select("chunk_id", "source_dataset", "n")
    assert sorted(map(tuple, got.collect())) == [("a", None, None), ("b", "d", 5)]
    chunk_store.write_chunks(frame([("a", "z", "")], SCHEMA), path, **REPLACE)
    assert rows(chunk_store.read_store(spark, path)) == [("a", "z", None), ("b", "y", "d")]
    with pytest.raises(ValueError, match="column n is int"):
        chunk_store.write_chunks(frame([("b", "y", "d", "5")], f"{SCHEMA}, n string"), path, **MERGE)
    with pytest.raises(ValueError, match="chunk_bucket"):
        chunk_store.write_chunks(frame([("b", "d", 1)], "chunk_id string, source_dataset string, chunk_bucket int"), path)
