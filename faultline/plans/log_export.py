"""A tree of task logs to a table of classified events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline import rules
from faultline.operators import logs, sinks
from faultline.sources.task_logs import read_task_logs

IDENTITY = ["path", "dag_id", "run_id", "task_id", "attempt"]


def events_of(lines: DataFrame) -> DataFrame:
    """Events with the number of their record in the log; all text is shuffled for the numbers."""
    return logs.log_events(lines, IDENTITY)


def file_events(lines: DataFrame, staged: str | None = None) -> DataFrame:
    """Events of lines as files give them, folded where they were read.  ``staged`` names a folder
    for the folded splits; without it the files are read twice."""
    return logs.file_events(lines, IDENTITY, staged)


def export_log_events(
    spark: SparkSession, root: str, path: str, form: str = "csv", staged: str | None = None
) -> None:
    events = file_events(read_task_logs(spark, root), staged)
    sinks.write_log_events(events.select(*rules.LOG_EVENT_COLUMNS), path, form)
