"""Writing: stores, keyed replacement, insert-if-absent, exports.

Stores are plain Parquet folders that a write replaces; ``chunk_store`` writes chunks by the
partitions they touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.blocks import cut_blocks
from faultline.functions.ordered import first_rows, null_safe_join, row_index
from faultline import rules

DATASET = "source_dataset"


def write_cases(cases: DataFrame, path: str) -> None:
    """Replace the parent store as a whole; ``cases`` must not be read from it."""
    cases.write.mode("overwrite").parquet(path)


def absent_rows(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Batch rows whose key the target does not hold."""
    return batch.join(target.select(key), key, "left_anti")


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, with those replaced whose key comes again."""
    return union_chunks(old.join(new.select(key), key, "left_anti"), new)


def union_chunks(kept: DataFrame, new: DataFrame) -> DataFrame:
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    return replace_rows(old, new, "chunk_id")


def replace_source(
    old: DataFrame, new: DataFrame, reset: bool = True, replace: bool = True
) -> DataFrame:
    """Content of the chunk store after an ingest.

    ``reset`` drops the whole store first; otherwise ``replace`` drops the datasets
    that ``new`` holds; otherwise new chunks are merged in by chunk id.
    """
    if reset:
        return new
    if replace:
        kept = null_safe_join(old, new.select(DATASET).distinct(), [DATASET], "left_anti")
        return union_chunks(kept, new)
    return upsert_chunks(old, new)


def first_per_key(batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row of each key in input order."""
    return first_rows(batch, [key], order, 1, "__rank").drop("__rank")


def insert_absent(
    target: DataFrame, batch: DataFrame, key: str, order: list[Column]
) -> DataFrame:
    """The rows to append: new keys only, first row of each key.

    The anti join runs first, so copies of stored keys are gone before ranking.
    Rows without a key are refused by a key constraint, hence dropped here.
    """
    keyed = batch.where(F.col(key).isNotNull())
    return first_per_key(absent_rows(target, keyed, key), key, order)


#: Cells are written as they are: the writer's default would trim their blanks.
_CSV = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def export_csv(df: DataFrame, path: str) -> int:
    """CSV export as a folder of parts; returns the rows written.

    The count is observed while writing, so the table is read once.
    """
    from pyspark.sql import Observation

    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").options(**_CSV).csv(path)
    return seen.get["rows"]


def write_log_events(events: DataFrame, path: str, form: str = "csv") -> None:
    """Classified log events in their fixed column order."""
    rows = events.select(*rules.LOG_EVENT_COLUMNS)
    writer = rows.write.mode("overwrite")
    if form == "csv":
        writer.options(**_CSV).csv(path)
    else:
        writer.parquet(path)


def stored_confidence(text: Column) -> Column:
    """Number before the first bar; 0.5 when there is no text."""
    head = F.trim(F.split(F.coalesce(text, F.lit(str(rules.DEFAULT_CONFIDENCE))), r"\|")[0])
    return head.try_cast("double")


def append_rca(
    repository: DataFrame, reports: DataFrame, block: str | None, order: list[Column]
) -> DataFrame:
    """Rows to append to the report repository, numbered after its highest id.

    ``block`` is a coarse non-decreasing function of ``order`` (a created day): it
    lets the ids be dense without sorting all rows in one task.  Without one, the reports
    are cut at quantiles of ``order``.
    """
    if block is None:
        reports, block = cut_blocks(reports, [], order, "__block"), "__block"
    highest = repository.agg(F.coalesce(F.max("incident_id"), F.lit(0))).scalar()
    numbered = row_index(reports, [], block, order, "__index")
    return numbered.select(
        (highest + F.col("__index")).cast("bigint").alias("incident_id"),
        "dag_id",
        "task_id",
        F.coalesce("root_cause", F.lit("")).alias("root_cause"),
        F.coalesce("business_impact", F.lit("")).alias("impact"),
        F.coalesce("resolution", F.lit("")).alias("resolution"),
        F.coalesce("preventive_actions", F.lit("")).alias("preventive_action"),
        stored_confidence(F.col("confidence_score")).alias("confidence_score"),
        "created_ts",
    )
