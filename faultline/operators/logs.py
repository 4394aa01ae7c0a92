"""Log lines to records to classified events.

A log is identified by ``key`` columns and ordered by ``(block, pos)``: the file
split and the line position for files, any coarse and any fine order otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import rules
from faultline.functions.ordered import running_sums
from faultline.functions.text import all_of, contains_any, strip
from faultline.operators.splits import fold_lines


def is_header(line: Column) -> Column:
    return line.rlike(r"\A" + rules.LOG_HEADER_PATTERN)


def numbered_records(
    lines: DataFrame,
    key: list[str],
    block: str = "block",
    pos: str = "line_pos",
    line: str = "line",
    header: Column | None = None,
) -> DataFrame:
    """Non-blank, stripped lines with the number of the record they belong to.

    Lines before the first header have no record and are dropped.
    """
    text = lines.withColumn(line, strip(F.col(line))).where(F.col(line) != "")
    starts = header if header is not None else is_header(F.col(line))
    marked = text.withColumn("is_header", starts)
    numbered = running_sums(
        marked, key, block, [F.col(pos)], {"record_no": F.col("is_header").cast("bigint")}
    )
    return numbered.where(F.col("record_no") > 0)


def fold_records(
    numbered: DataFrame,
    key: list[str],
    block: str = "block",
    pos: str = "line_pos",
    line: str = "line",
) -> DataFrame:
    """One row per record: its header line and its continuation lines as traceback.

    Lines are first joined within a block, where they already lie together, so only
    one row per record and block takes part in the final grouping.
    """
    continuation = F.when(~F.col("is_header"), F.struct(pos, line))
    parts = numbered.groupBy(*key, block, "record_no").agg(
        F.max(F.when(F.col("is_header"), F.col(line))).alias("__header"),
        F.min(F.when(F.col("is_header"), F.col(pos))).alias("__pos"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(continuation)), lambda x: x[line]), "\n"
        ).alias("__text"),
    )
    text_parts = F.sort_array(
        F.collect_list(F.when(F.col("__text") != "", F.struct(block, "__text")))
    )
    return parts.groupBy(*key, "record_no").agg(
        F.max("__header").alias("header"),
        F.min("__pos").alias("header_pos"),
        strip(F.array_join(F.transform(text_parts, lambda x: x["__text"]), "\n")).alias(
            "traceback"
        ),
    )


def parse_records(records: DataFrame, header: str = "header") -> DataFrame:
    """Timestamp, level, message, source and loc of a header line."""
    line = F.col(header)
    body = F.regexp_extract(line, rules.LOG_HEADER_PATTERN, 3)
    bare = F.regexp_replace(body, r"\s+source=\S+", "")
    return records.withColumns(
        {
            "timestamp": F.regexp_extract(line, rules.LOG_HEADER_PATTERN, 1),
            "level": F.regexp_extract(line, rules.LOG_HEADER_PATTERN, 2),
            "message": strip(F.regexp_replace(bare, r"\s+loc=\S+", "")),
            "source": F.regexp_extract(body, rules.LOG_SOURCE_PATTERN, 1),
            "loc": F.regexp_extract(body, rules.LOG_LOC_PATTERN, 1),
        }
    )


def event_type(message: Column, traceback: Column, level: Column) -> Column:
    """The first event rule that applies, else the level, else INFO."""
    fields = {"message": F.lower(message), "traceback": F.lower(traceback)}
    outcomes = [
        (all_of([fields[field].contains(p) for p in phrases]), F.lit(name))
        for field, phrases, name in rules.EVENT_RULES
    ] + [(level == name, F.lit(name)) for name in rules.EVENT_LEVELS]
    return reduce(
        lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest),
        reversed(outcomes),
        F.lit(rules.EVENT_DEFAULT),
    )


def classify_events(records: DataFrame) -> DataFrame:
    return records.withColumn(
        "event_type", event_type(F.col("message"), F.col("traceback"), F.col("level"))
    )


def log_events(lines: DataFrame, key: list[str], block: str = "block", pos: str = "line_pos",
               line: str = "line") -> DataFrame:
    """Lines of many logs to classified events."""
    numbered = numbered_records(lines, key, block, pos, line)
    folded = fold_records(numbered, key, block, pos, line)
    return classify_events(parse_records(folded))


def file_events(lines: DataFrame, identity: list[str], staged: str | None = None) -> DataFrame:
    """:func:`log_events` of lines as files give them, folded where they were read."""
    folded = fold_lines(lines, identity, is_header(F.col("line")), staged=staged)
    return classify_events(parse_records(folded))


def oom_events(host_lines: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """Out-of-memory lines per host, and whether there were any."""
    hits = F.count_if(contains_any(F.col(line), rules.OOM_PHRASES))
    return host_lines.groupBy(*by).agg(
        hits.alias("oom_count"), (hits > 0).alias("oom_detected")
    )
