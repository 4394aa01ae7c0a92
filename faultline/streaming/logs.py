"""Finished task logs, as they land, to classified events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from faultline import rules
from faultline.plans.log_export import file_events
from faultline.sources.task_logs import identified_lines, with_file_facts


def stream_log_events(
    spark: SparkSession, root: str, target: str, checkpoint: str, trigger: dict
) -> StreamingQuery:
    """Converts each new log file once.

    A file is read when it appears, so only finished attempts may be moved below
    ``root``.  A repeated batch overwrites its own folder.
    """
    files = spark.readStream.schema("value string").option(
        "recursiveFileLookup", "true"
    ).format("text").load(root)

    def convert(batch: DataFrame, number: int) -> None:
        events = file_events(identified_lines(batch)).select(*rules.LOG_EVENT_COLUMNS)
        events.write.mode("overwrite").parquet(f"{target}/batch_id={number}")

    return (
        with_file_facts(files)
        .writeStream.foreachBatch(convert)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
