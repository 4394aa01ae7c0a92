"""Task logs: text files below ``dag_id=/run_id=/task_id=/attempt=N.log``.

Logs are read as lines, so one very large log is read by many tasks.  ``block`` is
the file split a line comes from and ``line_pos`` orders the lines of a block.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import strip

LOG_KEY = ["path"]
_JSON_OBJECTS = "array<map<string,string>>"


def path_part(path: Column, name: str, pattern: str = "[^/]+") -> Column:
    """``name=value`` from a path, ``""`` when it is missing."""
    return F.regexp_extract(path, rf"{name}=({pattern})", 1)


def log_identity(path: Column) -> dict[str, Column]:
    """Ids of a log; escapes that Spark writes into folder names are undone."""
    return {
        "dag_id": _unescaped(path_part(path, "dag_id")),
        "run_id": _unescaped(path_part(path, "run_id")),
        "task_id": _unescaped(path_part(path, "task_id")),
        "attempt": path_part(path, "attempt", r"\d+"),
    }


def _unescaped(text: Column) -> Column:
    """Percent escapes as characters; a plus stays, bad escapes stay."""
    safe = F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(safe), text)


def read_task_logs(spark: SparkSession, root: str, **wanted: str) -> DataFrame:
    """One row per line, with the identity of the log taken from its path.

    ``wanted`` names values of ``dag_id``, ``run_id`` and ``task_id``: only the folders of
    these are read.  That needs a tree with all three folders above every file; without
    ``wanted`` files may lie anywhere below ``root``.
    """
    if not wanted:
        return identified_lines(
            with_file_facts(spark.read.option("recursiveFileLookup", "true").text(root))
        )
    rows = spark.read.text(root)
    for name, value in wanted.items():
        rows = rows.where(F.col(name).cast("string") == value)
    return identified_lines(with_file_facts(rows))


def list_task_logs(spark: SparkSession, root: str) -> DataFrame:
    """One row per file below ``root`` with the identity of its log; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        "path",
        *[value.alias(name) for name, value in log_identity(F.col("path")).items()],
        F.col("modificationTime").alias("modified"),
        F.col("length").alias("bytes"),
    )


def read_log_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of some files, named as :func:`list_task_logs` does."""
    if not paths:
        nothing = "line string, file_path string, modified timestamp, block bigint"
        return identified_lines(spark.createDataFrame([], nothing))
    # names may hold what a path pattern would take for its own
    literal = [re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in sorted(paths)]
    return identified_lines(with_file_facts(spark.read.text(literal)))


def with_file_facts(rows: DataFrame) -> DataFrame:
    """Text rows of a file source, batch or stream, with what is known of the file."""
    return rows.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def identified_lines(rows: DataFrame) -> DataFrame:
    """Lines with their position and the identity of their log."""
    numbered = rows.withColumn("line_pos", F.monotonically_increasing_id())
    located = numbered.withColumn("path", _unescaped(F.col("file_path")))
    return located.select(
        "path",
        *[value.alias(name) for name, value in log_identity(F.col("path")).items()],
        "modified",
        "block",
        "line_pos",
        "line",
    )


def json_log_line(line: Column) -> Column:
    """``[LEVEL] event`` for a JSON object, the line itself otherwise.

    The line is read as the one element of a list, as text after an object would
    otherwise be passed over.
    """
    listed = F.from_json(F.concat(F.lit("["), line, F.lit("]")), _JSON_OBJECTS)
    fields = F.try_element_at(listed, F.lit(1))
    level = F.upper(F.coalesce(fields["level"], F.lit("info")))
    event = F.coalesce(fields["event"], F.lit(""))
    is_object = line.startswith("{") & (F.size(listed) == 1)
    return F.when(is_object, F.concat(F.lit("["), level, F.lit("] "), event)).otherwise(line)


def json_log_lines(logs: DataFrame, line: str = "line", pos: str = "line_pos") -> DataFrame:
    """Stripped lines without the blank ones, JSON lines made readable.

    An event may hold line feeds: each of its lines that is not blank is a row.  ``pos``, if
    there, becomes a struct of itself and the place in the event, so it orders those too.
    """
    stripped = logs.withColumn(line, strip(F.col(line))).where(F.col(line) != "")
    readable = stripped.withColumn(line, json_log_line(F.col(line)))
    parts = readable.select("*", F.posexplode(F.split(line, "\n")).alias("__part", "__text")).where(
        strip(F.col("__text")) != ""
    )
    made = {line: F.col("__text")}
    if pos in logs.columns:
        made[pos] = F.struct(F.col(pos).alias("at"), F.col("__part").alias("part"))
    return parts.withColumns(made).drop("__part", "__text")
