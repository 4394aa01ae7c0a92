"""Key summaries: loads read only what can hold their keys."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators import keys
from faultline.plans import load
from faultline.streaming.load import loaded, stream_load

COLUMNS = "product_id,product_name" + ",x" * 17


def product_csv(path, ids):
    with open(path, "w", encoding="utf-8") as f:
        f.write(COLUMNS + "\n")
        f.writelines(f"{i},name {i}" + "," * 17 + "\n" for i in ids)
    return str(path)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_summaries_admit_all_own_keys_and_few_others(spark, kind):
    rng = random.Random(1)
    pool = rng.sample(range(10_000_000), 24_000)
    sets = {n: pool[n * 6000 : (n + 1) * 6000] for n in range(4)}
    as_keys = {n: spark.createDataFrame([(i,) for i in s], "k bigint").select(F.col("k").cast(kind)) for n, s in sets.items()}
    sums = None
    for n in range(3):
        one = keys.summarize(as_keys[n], "k").withColumn("load", F.lit(n))
        sums = one if sums is None else sums.union(one)
    sums = sums.cache()
    assert sums.where("load = 0").count() == 2
    for n in range(3):
        assert keys.holders(sums, as_keys[n].limit(1), "k", "load") == [n] or n in keys.holders(sums, as_keys[n].limit(1), "k", "load")
    foreign = [r["k"] for r in as_keys[3].limit(300).collect()]
    admitted = sum(len(keys.holders(sums, spark.createDataFrame([(k,)], f"k {kind}"), "k", "load")) for k in foreign[:20])
    assert admitted <= 3
    some = spark.createDataFrame([(sets[0][5],), (sets[2][7],)], "k bigint").select(F.col("k").cast(kind))
    assert {0, 2} <= set(keys.holders(sums, some, "k", "load"))
    assert keys.holders(sums, some.where("false"), "k", "load") == []
    sums.unpersist()


def test_loads_of_other_ranges_stay_closed(spark, tmp_path):
    table = str(tmp_path / "products")
    load.load_products(spark, product_csv(tmp_path / "a.csv", range(0, 500)), table, "a")
    load.load_products(spark, product_csv(tmp_path / "b.csv", range(1000, 1500)), table, "b")
    for part in (tmp_path / "products" / "rows" / "load_id=a").glob("*.parquet"):
        part.write_bytes(b"no parquet")  # whoever opens it fails
    load.load_products(spark, product_csv(tmp_path / "c.csv", [*range(1400, 1600), 1599]), table, "c")
    rows = spark.read.parquet(f"{table}/rows/load_id=c")
    assert sorted(r["product_id"] for r in rows.collect()) == list(range(1500, 1600))
    with pytest.raises(Exception, match="(?i)parquet"):
        load.load_products(spark, product_csv(tmp_path / "d.csv", [3]), table, "d")


def test_repeats_and_loads_without_summary(spark, tmp_path):
    table = str(tmp_path / "products")
    first = product_csv(tmp_path / "a.csv", range(0, 100))
    for _ in range(2):
        assert load.load_products(spark, first, table, "a").count() == 100
    assert load.load_products(spark, first, table, "b").count() == 100
    kept = spark.read.parquet(f"{table}/rows/load_id=a").withColumn("product_id", F.col("product_id") + 1000)
    kept.write.parquet(f"{table}/rows/load_id=old")  # as an earlier version of this library left it
    after = load.load_products(spark, product_csv(tmp_path / "c.csv", [1050, 5000]), table, "c")
    assert after.count() == 201 and after.where("product_id = 1050").count() == 1
    empty = load.load_products(spark, product_csv(tmp_path / "e.csv", []), table, "e")
    assert empty.count() == 201


def test_stream_opens_only_batches_that_can_hold_its_keys(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("at", T.LongType())])
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_load(stream, target, str(tmp_path / "check"), "k", "at", {"availableNow": True}).awaitTermination(90)
        return sorted(r["k"] for r in loaded(spark, target, schema).collect())

    assert step([(i, i) for i in range(50)] + [(None, 1), (3, 99)]) == list(range(50))
    for part in (tmp_path / "out" / "batch_id=0").glob("*.parquet"):
        kept, saved = part, part.read_bytes()
        part.write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):  # only the count of all rows opens it
        step([(i, i) for i in range(100, 150)])
    kept.write_bytes(saved)
    assert step([(49, 1), (150, 1), (150, 2)]) == [*range(50), *range(100, 151)]
