"""Session settings the operators are designed for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # run, dag and task ids must stay strings when they come from directory names
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call sites for error messages cost several round trips per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app: str = "faultline", master: str | None = None, **extra: str
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Applies to a session that somebody else has built what can still be set."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that every executor sees, for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master, where
    the driver and the tasks share one disk, may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        run = spark.sparkContext.applicationId
        base = _local_folders.setdefault(run, "") or tempfile.mkdtemp(prefix="faultline-")
        _local_folders[run] = base
    return os.path.join(base, name) if "://" not in base else f"{base.rstrip('/')}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, safe from lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()
