"""Audit evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.ordered import first_rows

TASK_KEY = ["dag_id", "task_id"]


def failed_audits(
    audit: DataFrame, dag_id: str | None = None, task_id: str | None = None
) -> DataFrame:
    """Failed audit rows, of one task when it is named."""
    failed = audit.where(F.col("status") == "FAILED")
    if dag_id is not None:
        failed = failed.where(F.col("dag_id") == dag_id)
    if task_id is not None:
        failed = failed.where(F.col("task_id") == task_id)
    return failed


def latest_failed(audit: DataFrame, tasks: DataFrame, key: list[str] = TASK_KEY) -> DataFrame:
    """The failed row with the highest ``audit_id`` for every task, and
    NO_FAILURE_FOUND for tasks that have none.  ``tasks`` has one row per task."""
    newest = first_rows(failed_audits(audit), key, [F.col("audit_id").desc()], 1, "__rank")
    rows = newest.withColumnRenamed("status", "audit_status").drop("__rank")
    status = F.when(F.col("audit_id").isNull(), "NO_FAILURE_FOUND").otherwise("SUCCESS")
    return tasks.select(*key).join(rows, key, "left").withColumn("status", status)
