"""Incremental product load: each micro-batch adds the keys the table lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.keys import ensure_table, near_loads
from faultline.operators.sinks import absent_rows, first_per_key


def stream_load(
    source: DataFrame, target: str, checkpoint: str, key: str, order: str, trigger: dict
) -> StreamingQuery:
    """Runs insert-if-absent per micro-batch.

    A batch is written to a folder named by its number and compared with the folders
    of earlier batches only, and of these with the ones whose key summary (in
    ``<target>-keys``) admits one of its keys.  A batch that is repeated after a failure
    overwrites its own folder, which takes the place of commit and rollback.
    """
    kinds = source.schema
    beside = f"{target.rstrip('/')}-keys"

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.where(F.col(key).isNotNull())
        ensure_table(spark, _with_number(kinds), target, "batch_id")
        earlier = spark.read.schema(_with_number(kinds)).parquet(target).where(F.col("batch_id") < number)
        near = near_loads(keyed.select(key), beside, earlier, key, "batch_id", number)
        if near:
            keyed = absent_rows(earlier.where(F.col("batch_id").cast("string").isin(near)), keyed, key)
        fresh = first_per_key(keyed, key, [F.col(order)])
        fresh.write.mode("overwrite").parquet(f"{target}/batch_id={number}")

    return (
        source.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _with_number(schema: T.StructType) -> T.StructType:
    numbered = [] if "batch_id" in schema.names else [T.StructField("batch_id", T.LongType())]
    return T.StructType([*schema.fields, *numbered])


def loaded(spark: SparkSession, target: str, schema, before: int | None = None) -> DataFrame:
    """The table as loaded so far, or by the batches before a number."""
    rows = spark.read.schema(_with_number(schema)).option("basePath", target).parquet(target)
    if before is not None:
        rows = rows.where(F.col("batch_id") < before)
    return rows.drop("batch_id")
