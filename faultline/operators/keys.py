"""Key summaries: which loads of a table can hold the keys of a new one.

A load leaves the range of its keys and a Bloom filter beside its rows.  The filter is a small
table: a key belongs to one bucket of 32,768 bits and sets ``PROBES`` of them.  An incoming batch
reads only loads whose range and filter admit one of its keys; what it finds there is then
compared exactly, so a filter that says too much costs time and nothing else.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a bucket, as Spark's bitmap functions have them.
BUCKET_BITS = 32_768
#: With ten bits a key and five probes about one foreign key in a hundred is admitted.
BITS_PER_KEY = 10
PROBES = 5


def ensure_table(spark: SparkSession, schema: T.StructType, path: str, by: str | None = None) -> None:
    """Makes an empty table where there is none, so that readers need not ask."""
    writer = spark.createDataFrame([], schema).write.mode("ignore")
    (writer.partitionBy(by) if by else writer).parquet(path)


def summary_schema(key: T.DataType, load: str, load_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("bucket", T.LongType()),
            T.StructField("bits", T.BinaryType()),
            T.StructField("buckets", T.LongType()),
            T.StructField("low", key),
            T.StructField("high", key),
            T.StructField("keys", T.LongType()),
            T.StructField(load, load_type),
        ]
    )


def _bucket(key: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(key), buckets)


def _probes(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BUCKET_BITS)) for i in range(PROBES)]


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1


def summarize(keys: DataFrame, key: str) -> DataFrame:
    """The summary of distinct, non-null ``keys``; one row without bits where there are none."""
    facts = keys.agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("keys")
    ).withColumn("buckets", F.greatest(F.ceil(F.col("keys") * BITS_PER_KEY / BUCKET_BITS), F.lit(1)).cast("bigint"))
    found = facts.first()
    column = F.col(key)
    bits = (
        keys.select(
            _bucket(column, F.lit(found["buckets"])).alias("bucket"), F.explode(F.array(*_probes(column))).alias("place")
        )
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("place").alias("bits"))
    )
    kind = keys.schema[key].dataType
    values = {"buckets": "bigint", "low": kind, "high": kind, "keys": "bigint"}
    if not found["keys"]:
        bits = keys.sparkSession.createDataFrame([(0, None)], "bucket bigint, bits binary")
    return bits.withColumns({n: F.lit(found[n]).cast(t) for n, t in values.items()})


def holders(summaries: DataFrame, keys: DataFrame, key: str, load: str) -> list:
    """Loads that may hold one of ``keys`` (distinct, not null), by their ``summaries``.

    Ranges come first: one row per load.  The filters of the loads that are left are asked for
    each key, unless these loads together hold no more keys than there would be questions.
    """
    span = keys.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).first()
    if not span["n"]:
        return []
    kind = keys.schema[key].dataType
    near = (
        summaries.where(
            (F.col("low") <= F.lit(span["high"]).cast(kind)) & (F.col("high") >= F.lit(span["low"]).cast(kind))
        )
        .select(load, "buckets", "keys")
        .distinct()
        .collect()
    )
    names = sorted(r[load] for r in near)
    if span["n"] * len(near) >= sum(r["keys"] for r in near):
        return names
    asked = F.explode(F.array(*[F.struct(F.lit(r[load]).alias(load), F.lit(r["buckets"]).alias("buckets")) for r in near]))
    questions = keys.select(F.col(key), asked.alias("of")).select(
        key, F.col(f"of.{load}").alias(load), _bucket(F.col(key), F.col("of.buckets")).alias("bucket")
    )
    filters = summaries.where(F.col(load).isin(names)).select(load, "bucket", "bits")
    admitted = questions.join(filters, [load, "bucket"])
    for place in _probes(F.col(key)):
        admitted = admitted.where(_is_set(F.col("bits"), place))
    return sorted(r[load] for r in admitted.select(load).distinct().collect())


def near_loads(
    wanted: DataFrame, beside: str, rows: DataFrame, key: str, load: str, value: str | int
) -> list[str]:
    """Names of other loads that may hold keys of the load ``value``, whose summary is written.

    ``wanted`` holds the keys of the load, null and repeated ones too; they are staged in the
    folder ``beside``, where summaries are kept.  ``rows`` are the rows of the loads to look at.
    """
    spark = wanted.sparkSession
    sums = summary_schema(wanted.schema[key].dataType, load, rows.schema[load].dataType)
    ensure_table(spark, sums, f"{beside}/keys", load)
    staged = f"{beside}/incoming/{load}={value}"
    wanted.where(F.col(key).isNotNull()).select(key).distinct().write.mode("overwrite").parquet(staged)
    asked = spark.read.schema(T.StructType([wanted.schema[key]])).parquet(staged)
    known = spark.read.schema(sums).parquet(f"{beside}/keys").where(F.col(load) != F.lit(value))
    near = {str(name) for name in holders(known, asked, key, load)} | unsummarized(rows, known, load)
    summarize(asked, key).write.mode("overwrite").parquet(f"{beside}/keys/{load}={value}")
    return sorted(near - {str(value)})


def unsummarized(rows: DataFrame, summaries: DataFrame, load: str) -> set[str]:
    """Names of loads that have files but no summary, of which nothing is known.  The files are
    not opened: their folders name the loads."""
    found = (re.search(rf"/{load}=([^/]+)/", path) for path in rows.inputFiles())
    known = {str(r[load]) for r in summaries.select(load).distinct().collect()}
    return {unquote(f[1]) for f in found if f} - known
