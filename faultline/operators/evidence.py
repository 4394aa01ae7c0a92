"""Error evidence of each log, found line by line.

A log is never put together in one cell.  Every line yields what it can show on its
own or with the line after it, and small aggregates per log keep the earliest find,
so a log that holds a third of all lines is worked on by many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline import rules
from faultline.functions.ordered import first_rows, null_safe_join
from faultline.functions.text import any_of, filled, strip
from faultline.operators import splits
from faultline.session import checkpointed
from faultline.sources.task_logs import json_log_lines, list_task_logs, read_log_files

NO_LOG_MESSAGE = "No log content available"
UNKNOWN = "Unknown"


def phrase_rank(low: Column) -> Column:
    """Place of the first listed error phrase in a lower-case text; null if none."""
    ranked = list(enumerate(phrase.lower() for phrase, _ in rules.ERROR_PHRASES))
    none = F.lit(None).cast("int")
    return reduce(
        lambda rest, item: F.when(low.contains(item[1]), F.lit(item[0])).otherwise(rest),
        reversed(ranked),
        none,
    )


def ranked_error_type(rank: Column) -> Column:
    """Error type behind a phrase rank, Unknown without one."""
    names = F.array(*[F.lit(name) for _, name in rules.ERROR_PHRASES])
    return F.coalesce(F.try_element_at(names, rank + 1), F.lit(UNKNOWN))


def match_keyword(texts: DataFrame, text: str, name: str = "error_type") -> DataFrame:
    """Error type of single texts."""
    return texts.withColumn(name, ranked_error_type(phrase_rank(F.lower(F.col(text)))))


def with_next_lines(lines: DataFrame, key: list[str], block: str, pos: str, line: str) -> DataFrame:
    """Adds ``next_line`` and ``third_line``: the two lines that follow in the same log,
    across blocks too, blocks of one line included."""
    window = Window.partitionBy(*key, block).orderBy(pos)
    blocks = Window.partitionBy(*key).orderBy(block)
    heads = first_rows(lines.select(*key, block, pos, line), [*key, block], [F.col(pos)], 2, "__rank")
    pairs = heads.groupBy(*key, block).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__rank", line))), lambda x: x[line]).alias("__heads")
    )
    empty = F.array().cast("array<string>")
    later = [F.coalesce(F.lead("__heads", n).over(blocks), empty) for n in (1, 2)]
    after = pairs.select(*key, block, F.concat(*later).alias("__after"))
    local = lines.withColumns(
        {"next_line": F.lead(line).over(window), "third_line": F.lead(line, 2).over(window)}
    )
    joined = null_safe_join(local, after, [*key, block], "inner")
    first, second = F.get("__after", F.lit(0)), F.get("__after", F.lit(1))
    return joined.select(
        *lines.columns,
        F.coalesce("next_line", first).alias("next_line"),
        F.coalesce("third_line", F.when(F.col("next_line").isNull(), second).otherwise(first)).alias("third_line"),
    )


def _earliest(condition: Column, order: Column, value: Column) -> Column:
    return F.min(F.when(condition, F.struct(order.alias("at"), value.alias("found"))))["found"]


def _starting_in(joined: Column, pattern: str, group: int) -> tuple[Column, Column]:
    """Whether a match begins in the first of the joined lines, and the match, which may
    end in a later one.  A match that lies wholly in later lines is left to them."""
    begins = rf"(?id)\A[^\n]*?(?:{pattern})"
    return joined.rlike(begins), F.regexp_extract(joined, begins, group)


def error_evidence(
    lines: DataFrame, key: list[str], block: str = "block", pos: str = "line_pos", line: str = "line",
    in_place: bool = False,
) -> DataFrame:
    """Per log: error type, message, product id, traceback and execution time.

    ``lines`` are non-blank and hold no line feed, as ``json_log_lines`` leaves them.  With
    ``in_place`` they come straight from files: what follows a line is then seen where it was
    read, and only the ends of file splits are shuffled.  Otherwise they are read four times, so what
    makes them (JSON events parsed, for one) is done once and they are checkpointed.
    """
    if not in_place:
        lines = checkpointed(lines.select(*key, block, pos, line))
    text, order = F.col(line), F.struct(block, pos)
    # columns of their own, so that they are computed once per line
    # a pattern has two gaps at most, so a match ends in the second line after its start
    followed = splits.chained_lines(lines, line) if in_place else with_next_lines(lines, key, block, pos, line)
    chained = followed.withColumns(
        {"__joined": F.concat_ws("\n", text, "next_line", "third_line"), "__low": F.lower(text)}
    )
    joined, low = F.col("__joined"), F.col("__low")

    # a literal that every match begins with keeps the patterns off most lines
    finds = [F.min(phrase_rank(low)).alias("__phrase")]
    for i, (pattern, literal) in enumerate(
        zip(rules.ERROR_MESSAGE_PATTERNS, rules.ERROR_MESSAGE_LITERALS)
    ):
        hit, found = _starting_in(joined, f"({pattern})", 1)
        hit = low.contains(literal) & hit
        finds.append(_earliest(hit, order, found).alias(f"__message{i}"))
    words = any_of([low.contains(w) for w in rules.ERROR_LINE_WORDS])
    finds.append(_earliest(words, order, strip(text)).alias("__word_line"))
    for i, pattern in enumerate(rules.PRODUCT_ID_PATTERNS):
        hit, found = _starting_in(joined, pattern, 1)
        hit = low.contains(rules.PRODUCT_ID_LITERAL) & hit
        finds.append(_earliest(hit, order, found).alias(f"__product{i}"))
    stamp = text.rlike(rules.ISO_TIMESTAMP_PATTERN)
    finds.append(
        _earliest(stamp, order, F.regexp_extract(text, rules.ISO_TIMESTAMP_PATTERN, 1)).alias(
            "execution_time"
        )
    )
    found = chained.groupBy(*key).agg(*finds)

    messages = [F.col(f"__message{i}") for i in range(len(rules.ERROR_MESSAGE_PATTERNS))]
    products = [F.col(f"__product{i}") for i in range(len(rules.PRODUCT_ID_PATTERNS))]
    message = F.substring(strip(F.coalesce(*messages)), 1, rules.ERROR_MESSAGE_CHARS)
    result = found.select(
        *key,
        ranked_error_type(F.col("__phrase")).alias("error_type"),
        F.coalesce(message, F.col("__word_line"), F.lit(UNKNOWN)).alias("error_message"),
        F.coalesce(*products).alias("product_id"),
        "execution_time",
    )
    tracebacks = log_traceback(lines, key, block, pos, line)
    return null_safe_join(result, tracebacks, key, "left").withColumn(
        "traceback", F.coalesce("traceback", F.lit(""))
    )


def log_traceback(
    lines: DataFrame, key: list[str], block: str = "block", pos: str = "line_pos", line: str = "line"
) -> DataFrame:
    """2,000 characters from the first "Traceback" on, for the logs that have one.

    A line takes up two characters at least, so the first 1,000 lines from there hold
    them all; map tasks drop the others before the shuffle.
    """
    order = F.struct(block, pos)
    starts = (
        lines.where(F.col(line).contains(rules.TRACEBACK_WORD))
        .groupBy(*key)
        .agg(F.min(order).alias("__start"))
    )
    tail = null_safe_join(lines, starts, key, "inner").where(order >= F.col("__start"))
    most = rules.TRACEBACK_CHARS // 2
    near = first_rows(tail, key, [F.col(block), F.col(pos)], most, "__rank")
    clipped = F.when(
        F.col("__rank") == 1,
        F.expr(f"substring({line}, locate('{rules.TRACEBACK_WORD}', {line}))"),
    ).otherwise(F.col(line))
    cut = F.substring(clipped, 1, rules.TRACEBACK_CHARS)
    ordered = F.sort_array(F.collect_list(F.struct("__rank", cut.alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")
    return near.groupBy(*key).agg(
        F.substring(joined, 1, rules.TRACEBACK_CHARS).alias("traceback")
    )


def latest_log(
    logs: DataFrame, triggers: DataFrame, root: str | None = None
) -> DataFrame:
    """The log to read for each trigger: ``dag_id, task_id, run_id, path, tier``.

    Tier 1 is the exact run, tier 2 any run of the task, tier 3 any file whose name
    begins with the task id; within a tier the newest file wins, then the path.
    ``logs`` has one row per file.  Each tier keeps one file per join key before it
    meets the triggers.  Tier 3 compares name prefixes of the lengths that task ids
    have, as an equality, and not every file with every task.
    """
    newest = F.max(F.struct("modified", "path")).alias("__file")
    files = logs.select("path", "dag_id", "run_id", "task_id", "modified").distinct()
    exact = files.groupBy("dag_id", "task_id", "run_id").agg(newest)
    any_run = files.groupBy("dag_id", "task_id").agg(newest)

    tasks = triggers.select("task_id").where(F.col("task_id") != "").distinct()
    # one row per length of a task id; Spark decides how to join them
    lengths = tasks.select(F.length("task_id").alias("__n")).distinct()
    names = files.withColumn("__name", F.regexp_extract("path", r"([^/]*)\.log$", 1))
    prefixes = names.select(
        "path", "modified", F.col("__name"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.length("__name"), F.lit(1)))).alias("__n"),
    ).join(lengths, "__n", "left_semi")
    named = (
        prefixes.where(F.length("__name") >= F.col("__n"))
        .select(F.expr("substring(__name, 1, __n)").alias("task_id"), "modified", "path")
        .join(tasks, "task_id", "left_semi")
        .groupBy("task_id")
        .agg(newest)
    )
    asked = triggers.select("dag_id", "task_id", "run_id").distinct()

    def tiered(found: DataFrame, keys: list[str], tier: str) -> DataFrame:
        return found.select(*keys, F.col("__file").alias(tier))

    joined = (
        asked.join(tiered(exact, ["dag_id", "task_id", "run_id"], "__t1"),
                   ["dag_id", "task_id", "run_id"], "left")
        .join(tiered(any_run, ["dag_id", "task_id"], "__t2"), ["dag_id", "task_id"], "left")
        .join(tiered(named, ["task_id"], "__t3"), ["task_id"], "left")
    )
    tier = (
        F.when(F.col("__t1").isNotNull(), 1)
        .when(F.col("__t2").isNotNull(), 2)
        .when(F.col("__t3").isNotNull(), 3)
    )
    return joined.select(
        "dag_id", "task_id", "run_id",
        F.coalesce("__t1", "__t2", "__t3")["path"].alias("path"),
        tier.cast("bigint").alias("tier"),
    )


def sla_message(dag_id: Column, task_id: Column) -> Column:
    return filled(rules.SLA_MESSAGE, task=task_id, dag=dag_id)


def sla_evidence(triggers: DataFrame) -> DataFrame:
    """Log evidence of SLA runs, which have no log of their own."""
    return triggers.where(F.col("run_id").eqNullSafe(rules.SLA_RUN_ID)).select(
        "dag_id", "task_id", "run_id", "execution_date",
        F.lit("SUCCESS").alias("status"),
        F.lit(False).alias("log_found"),
        F.lit("SLAMiss").alias("error_type"),
        sla_message(F.col("dag_id"), F.col("task_id")).alias("error_message"),
        F.lit(None).cast("string").alias("product_id"),
        F.lit("").alias("traceback"),
        F.col("execution_date").alias("execution_time"),
    )


def log_evidence(triggers: DataFrame, logs: DataFrame) -> DataFrame:
    """Log evidence of every trigger: its latest log, or the SLA substitute.

    ``logs`` are lines as :func:`faultline.sources.task_logs.read_task_logs` gives them.
    """
    files = logs.select("path", "dag_id", "run_id", "task_id", "modified")
    normal = _with_runs(triggers)
    chosen = latest_log(files, normal)
    wanted = chosen.select("path").where(F.col("path").isNotNull()).distinct()
    content = logs.select("path", "block", "line_pos", "line").join(wanted, "path", "left_semi")
    found = error_evidence(json_log_lines(content), ["path"])
    return _evidence(triggers, chosen, found)


def selected_logs(spark: SparkSession, triggers: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """The log chosen for each trigger of a run, and the lines of the chosen logs.

    The choice is made on the list of files, which opens none of them.  Then the chosen files
    alone are read, so the rows read grow with the triggers and not with the tree.
    """
    chosen = latest_log(list_task_logs(spark, root), _with_runs(triggers))
    paths = chosen.select("path").where(F.col("path").isNotNull()).distinct().collect()
    return chosen, read_log_files(spark, [r["path"] for r in paths])


def tree_log_evidence(spark: SparkSession, triggers: DataFrame, root: str) -> DataFrame:
    """:func:`log_evidence` from a tree of logs, of which only the chosen files are read."""
    chosen, content = selected_logs(spark, triggers, root)
    lines = json_log_lines(content.select("path", "block", "line_pos", "line"))
    return _evidence(triggers, chosen, error_evidence(lines, ["path"], in_place=True))


def _with_runs(triggers: DataFrame) -> DataFrame:
    return triggers.where(~F.col("run_id").eqNullSafe(rules.SLA_RUN_ID))


def _evidence(triggers: DataFrame, chosen: DataFrame, found: DataFrame) -> DataFrame:
    normal = _with_runs(triggers)
    located = null_safe_join(normal, chosen, ["dag_id", "task_id", "run_id"]).join(
        found, "path", "left"
    )
    has_log = F.col("error_type").isNotNull()
    read = located.select(
        "dag_id", "task_id", "run_id", "execution_date",
        F.lit("SUCCESS").alias("status"),
        has_log.alias("log_found"),
        F.coalesce("error_type", F.lit(UNKNOWN)).alias("error_type"),
        F.coalesce("error_message", F.lit(NO_LOG_MESSAGE)).alias("error_message"),
        "product_id",
        F.coalesce("traceback", F.lit("")).alias("traceback"),
        "execution_time",
    )
    return read.unionByName(sla_evidence(triggers))
