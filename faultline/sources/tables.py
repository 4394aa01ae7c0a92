"""Operational tables and the stores the engine writes itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import rules
from faultline.operators.chunk_store import read_store

BAD_ROW = "bad_row"


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Product CSV of any load volume, typed, with the input order.

    ``bad_row`` holds the text of a row that does not fit the schema (a cell of the wrong
    type, too few or too many cells) and is null for all others.  Every cell is parsed
    whatever columns a query takes, so a row is bad in all queries or in none.
    """
    return (
        spark.read.schema(f"{rules.PRODUCT_SCHEMA}, {BAD_ROW} string")
        .option("escape", '"')
        .option("columnNameOfCorruptRecord", BAD_ROW)
        .option("columnPruning", "false")
        .csv(path, header=True, enforceSchema=True, dateFormat="yyyy-MM-dd")
        .withColumn("input_pos", F.monotonically_increasing_id())
    )


def read_table(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """Audit, product, session, lock and counter tables.

    A snapshot folder under ``root`` when one is given, else a catalog table.
    """
    return spark.read.parquet(f"{root.rstrip('/')}/{name}") if root else spark.table(name)


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    name: str,
    key: str,
    bounds: tuple[int, int],
    slices: int,
    **options: str,
) -> DataFrame:
    """The same tables from a live database, read in ``slices`` key ranges."""
    return spark.read.format("jdbc").options(
        url=url,
        dbtable=name,
        partitionColumn=key,
        lowerBound=str(bounds[0]),
        upperBound=str(bounds[1]),
        numPartitions=str(slices),
        **options,
    ).load()


def read_products_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Parent case store; raises when it has not been written yet."""
    return spark.read.parquet(path)


def read_chunks(spark: SparkSession, path: str, source_dataset: str) -> DataFrame:
    """Chunks of one source dataset; the store is partitioned by it."""
    return in_dataset(read_store(spark, path), source_dataset)


def in_dataset(chunks: DataFrame, source_dataset: str) -> DataFrame:
    return chunks.where(F.col("source_dataset") == source_dataset)


def chunk_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("chunk_count"))
