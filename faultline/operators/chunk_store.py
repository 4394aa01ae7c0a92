"""The chunk store: a Parquet folder by source dataset and bucket of the chunk id.

A write touches the partitions it has to.  Merging by chunk id reads the buckets of the incoming
ids only, in which alone their older forms can stand, and overwrites those partitions of them that
gain or lose a chunk; replacing datasets overwrites the partitions of these.  An overwrite cannot
empty a partition, so one that loses all its chunks gets a row that says so, which readers leave
out.  The number of buckets and the columns stand in a small table beside the rows.

A batch of n chunks touches at most n buckets; one spread over all buckets touches them all.
:func:`bucket_number` gives buckets of some hundred megabytes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.ordered import null_safe_join
from faultline.operators.keys import ensure_table
from faultline.operators.sinks import DATASET, union_chunks, upsert_chunks

BUCKET = "chunk_bucket"
EMPTIED = "chunk_partition_emptied"
PLACE = [DATASET, BUCKET]
_FACTS = "buckets int, columns int, schema string"


def bucket_number(documents: int, each: int = 50_000, most: int = 4_096) -> int:
    """Buckets for a store of so many documents; more than ``most`` would be too many folders."""
    return min(most, 1 + documents // each)


def _facts(spark: SparkSession, path: str) -> tuple[int, T.StructType] | None:
    """Buckets and columns of a complete store; a store only ever gains columns."""
    ensure_table(spark, T._parse_datatype_string(_FACTS), f"{path}/facts")
    facts = spark.read.schema(_FACTS).parquet(f"{path}/facts")
    row = facts.orderBy(F.col("columns").desc()).first()
    return (row.buckets, T.StructType.fromJson(json.loads(row.schema))) if row else None


def _add_facts(spark: SparkSession, path: str, buckets: int, schema: T.StructType) -> None:
    facts = spark.createDataFrame([(buckets, len(schema), schema.json())], _FACTS)
    facts.coalesce(1).write.mode("append").parquet(f"{path}/facts")


def _plain(schema: T.StructType) -> T.StructType:
    """The columns as Parquet gives them back: nullable, the dataset as text."""
    fields = [
        T.StructField(f.name, T.StringType() if f.name == DATASET else f.dataType) for f in schema
    ]
    return T.StructType(fields)


def _widened(stored: T.StructType, new: T.StructType) -> T.StructType:
    """Columns of both; one that changes its type is an error, found before any write."""
    known = {f.name: f.dataType for f in stored}
    for field in new:
        if known.get(field.name, field.dataType) != field.dataType:
            raise ValueError(
                f"column {field.name} is {known[field.name].simpleString()} in the store "
                f"and {field.dataType.simpleString()} in the new chunks"
            )
    return T.StructType([*stored, *[f for f in new if f.name not in known]])


def _placed(chunks: DataFrame, buckets: int) -> DataFrame:
    # a partition named by an empty text is read back as null
    dataset = F.nullif(F.col(DATASET).cast("string"), F.lit(""))
    bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")
    return chunks.withColumn(DATASET, dataset).withColumn(BUCKET, bucket)


def _all_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType(
        [*schema, T.StructField(BUCKET, T.IntegerType()), T.StructField(EMPTIED, T.BooleanType())]
    )
    return spark.read.schema(full).parquet(f"{path}/rows")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All chunks; raises where no store has been written."""
    facts = _facts(spark, path)
    if facts is None:
        raise FileNotFoundError(f"no chunk store has been written to {path}")
    return _all_rows(spark, path, facts[1]).where(F.col(EMPTIED).isNull()).drop(BUCKET, EMPTIED)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """Few files a partition: rebalancing joins small partitions and splits large ones."""
    even = rows.hint("rebalance", *PLACE)
    writer = even.write.mode("overwrite").option("partitionOverwriteMode", mode)
    writer.partitionBy(*PLACE).parquet(f"{path}/rows")


def _merged(rows: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New content of the touched partitions, and the places that lose a chunk.

    The numbers of the touched buckets pass through the driver, so only their folders are read.
    """
    asked = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
    old = rows.where(F.col(BUCKET).isin(asked) & F.col(EMPTIED).isNull())
    losing = old.join(fresh.select("chunk_id"), "chunk_id", "left_semi").select(PLACE).distinct()
    touched = losing.union(fresh.select(PLACE)).distinct()
    return upsert_chunks(null_safe_join(old, touched, PLACE, "left_semi"), fresh), losing


def write_chunks(
    new: DataFrame, path: str, reset: bool = True, replace: bool = True, buckets: int = 64
) -> None:
    """Brings the store to what ``sinks.replace_source`` describes.

    ``reset`` writes it anew with ``buckets``; later writes keep that number.  The others stage
    the new chunks in ``incoming`` and read them from there.  Partitions are exchanged one after the
    other when all tasks have finished; a write that fails before leaves the rows as they were
    and can be repeated, as can one that has succeeded.  Chunks without an id replace nothing.
    New columns are null in older rows.  A null or empty dataset is the dataset null.
    """
    spark = new.sparkSession
    taken = {BUCKET, EMPTIED} & set(new.columns)
    if taken:
        raise ValueError(f"column names the store needs itself: {sorted(taken)}")
    facts = _facts(spark, path)
    if reset or facts is None:
        # without facts a store counts as not written, so a reset that fails is one to repeat
        spark.createDataFrame([], _FACTS).write.mode("overwrite").parquet(f"{path}/facts")
        _write(_placed(new, buckets), path, "static")
        _add_facts(spark, path, buckets, _plain(new.schema))
        return
    buckets, stored = facts
    schema = _widened(stored, _plain(new.schema))
    _placed(new, buckets).write.mode("overwrite").parquet(f"{path}/incoming")
    fresh = spark.read.parquet(f"{path}/incoming")
    if len(schema) > len(stored):
        _add_facts(spark, path, buckets, schema)
    rows = _all_rows(spark, path, schema)
    if replace:
        places = rows.where(F.col(EMPTIED).isNull()).select(PLACE).distinct()
        content = fresh
        losing = null_safe_join(places, fresh.select(DATASET).distinct(), [DATASET], "left_semi")
    else:
        content, losing = _merged(rows, fresh)
    emptied = null_safe_join(losing, fresh.select(PLACE).distinct(), PLACE, "left_anti")
    gone = emptied.withColumn(EMPTIED, F.lit(True))
    _write(union_chunks(content, gone), path, "dynamic")
