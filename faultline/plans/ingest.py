"""Incident CSV to case store and chunk store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from faultline import rules
from faultline.operators import cases as c
from faultline.operators import chunks as ch
from faultline.operators import sinks
from faultline.operators.case_index import write_case_index
from faultline.operators.chunk_store import bucket_number, write_chunks
from faultline.sources.incidents import read_incidents


@dataclass
class Prepared:
    """Stages of an ingest, for the sinks and for the statistics."""

    columns: list[str]
    raw: DataFrame
    distinct: DataFrame
    assigned: DataFrame
    merged: DataFrame


def prepare(
    raw: DataFrame,
    source_dataset: str = rules.SOURCE_DATASET,
    id_override: str = "",
    staged: str | None = None,
) -> Prepared:
    """Names, cleaning, exact copies, ids, merged duplicates.

    Choosing the id column reads one aggregation row.  With ``staged`` the distinct
    rows are written there once and read back, so the later passes do not repeat the
    scan and the cleaning, and lost executors cost no more than their own part.
    """
    named, mapping = c.normalize_columns(raw)
    columns = c.source_columns(named)
    distinct = c.drop_exact(c.clean_cells(named, columns), columns)
    if staged:
        distinct.write.mode("overwrite").parquet(staged)
        distinct = raw.sparkSession.read.parquet(staged)
    id_column = c.choose_case_id(distinct, id_override)
    with_json = c.raw_fields_json(distinct, columns)
    assigned = c.assign_case_id(with_json, columns, id_column, mapping, source_dataset)
    return Prepared(columns, named, distinct, assigned, c.merge_cases(assigned))


def ingest(
    spark: SparkSession,
    csv_path: str,
    case_path: str,
    chunk_path: str,
    stage_path: str,
    source_dataset: str = rules.SOURCE_DATASET,
    id_override: str = "",
    metadata_override: str = "",
    size: int = rules.CHUNK_CHARS,
    overlap: int = rules.CHUNK_OVERLAP,
    reset: bool = True,
    replace: bool = True,
    multi_line: bool = True,
    index_path: str | None = None,
) -> DataFrame:
    """Runs the ingest and returns its one-row statistics.

    The chunk step reads the case store just written, not the plan that made it.  With
    ``index_path`` the ids of the new store are indexed there, in place of an earlier index.
    """
    raw = read_incidents(spark, csv_path, multi_line)
    stages = prepare(raw, source_dataset, id_override, stage_path)
    sinks.write_cases(c.case_store(stages.merged), case_path)
    stored = spark.read.parquet(case_path)
    if index_path:
        write_case_index(stored, index_path)
    fresh = ch.chunk_rows(stored, size, overlap, metadata_override)
    write_chunks(fresh, chunk_path, reset, replace, bucket_number(stored.count()))
    return c.ingest_stats(
        stages.raw, len(stages.columns), stages.distinct, stages.assigned, stored, fresh
    )
