"""Product CSV into a product table: new keys only, any volume.

The table is a folder of loads, ``rows/load_id=...``: a load adds its own folder and leaves
the others as they are.  Beside it, ``keys/load_id=...`` sums up the keys of the load's file, written
before its rows, so what a load holds is never more than its summary admits.  A load reads the
rows of those earlier loads only that may hold one of its keys.  A load that is repeated under
its id takes the place of its first try.  Rows that the table cannot take go to
``rejects/load_id=...`` with their text and the reason.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import rules
from faultline.operators import keys, sinks
from faultline.sources.tables import BAD_ROW, read_products

KEY = "product_id"
LOAD = "load_id"


def _schema(more: str = "") -> T.StructType:
    text = f"{rules.PRODUCT_SCHEMA}{more}, {LOAD} string"
    return T._parse_datatype_string(text)


def _rows(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.schema(_schema()).parquet(f"{table_path}/rows")


def load_products(
    spark: SparkSession, csv_path: str, table_path: str, load_id: str | None = None
) -> DataFrame:
    """Adds the new products of a file to the table and returns the new table.

    The file is read for its keys, which are staged below ``keys``, and for its rows; and again
    only where some were rejected, which are counted while the new ones are written.
    """
    load_id = load_id or uuid.uuid4().hex
    batch = read_products(spark, csv_path)
    refused = F.col(BAD_ROW).isNotNull() | F.col(KEY).isNull()
    keys.ensure_table(spark, _schema(), f"{table_path}/rows", LOAD)
    others = _rows(spark, table_path).where(F.col(LOAD) != load_id)
    near = keys.near_loads(batch.where(~refused).select(KEY), table_path, others, KEY, LOAD, load_id)

    seen = Observation()
    counted = batch.observe(seen, F.count_if(refused).alias("rejected"))
    usable = counted.where(~refused).drop(BAD_ROW)
    order = [F.col("input_pos")]
    if near:
        fresh = sinks.insert_absent(others.where(F.col(LOAD).cast("string").isin(near)), usable, KEY, order)
    else:
        fresh = sinks.first_per_key(usable, KEY, order)
    fresh.drop("input_pos").write.mode("overwrite").parquet(f"{table_path}/rows/{LOAD}={load_id}")
    if seen.get["rejected"]:
        keys.ensure_table(spark, _schema(f", {BAD_ROW} string, input_pos long, reason string"), f"{table_path}/rejects", LOAD)
        reason = F.when(F.col(BAD_ROW).isNotNull(), "malformed").otherwise("no key")
        batch.where(refused).withColumn("reason", reason).write.mode("overwrite").parquet(
            f"{table_path}/rejects/{LOAD}={load_id}"
        )
    return product_table(spark, table_path)


def product_table(spark: SparkSession, table_path: str) -> DataFrame:
    """All products loaded so far."""
    return _rows(spark, table_path).drop(LOAD)


def rejected_products(spark: SparkSession, table_path: str) -> DataFrame | None:
    """Rejected rows of all loads with ``reason`` and ``load_id``; None where there are none."""
    schema = _schema(f", {BAD_ROW} string, input_pos long, reason string")
    keys.ensure_table(spark, schema, f"{table_path}/rejects", LOAD)
    found = spark.read.schema(schema).parquet(f"{table_path}/rejects")
    return None if found.isEmpty() else found


def export_products(spark: SparkSession, table_path: str, csv_path: str) -> int:
    return sinks.export_csv(product_table(spark, table_path), csv_path)
