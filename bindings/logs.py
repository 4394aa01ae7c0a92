"""Logs made from ``events`` and ``conversations``.

Every event is one line of the log of its user: structured header lines, JSON lines,
tracebacks and error texts, depending on the event type and the number in its props.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.cases import strip_sql
from bindings.common import Registry, fresh_folder, table
from faultline import rules
from faultline.functions.text import strip
from faultline.operators import evidence, logs, report, sinks
from faultline.plans.log_export import file_events
from faultline.sources import task_logs

REGISTRY = Registry()
query = REGISTRY.query

# One text for both engines: the line an event writes.
K = "cast(regexp_extract(props, '[0-9]+', 0) as int)"
AT = "substr(cast(ts as string), 1, 19)"
LINE = f"""case
    when event_type = 'view' then concat('[', {AT}, '] `INFO` - Read ', {K}, ' rows  source=etl.reader_', {K}, ' loc=load.py:', event_id)
    when event_type = 'click' and {K} < 30 then concat('[', {AT}, '] `WARNING` - *** SLA MISS *** launching autorca source=etl.sla')
    when event_type = 'click' and {K} < 60 then concat('  ', '[', {AT}, '] `INFO` - Inserted ', {K}, ' rows loc=x')
    when event_type = 'click' then concat('{{"level": "warning", "event": "chunk ', {K}, ' slow", "ts": "', replace({AT}, ' ', 'T'), '"}}')
    when event_type = 'signup' and {K} < 20 then props
    when event_type = 'signup' and {K} < 40 then '   '
    when event_type = 'signup' and {K} < 60 then concat('{{"event": "Task instance is in running state ', {K}, '"}}')
    when event_type = 'signup' then concat('plain text ', {K}, ' - still fine')
    when event_type = 'purchase' and {K} < 50 then concat('[', {AT}, '] `ERROR` - Task failed with exception number ', {K})
    when event_type = 'purchase' then concat('[', {AT}, '] `ERROR` - step ', {K}, ' stopped source=a.b_c extra')
    when {K} < 15 then 'Traceback (most recent call last):'
    when {K} < 30 then concat('psycopg2.errors.UniqueViolation: duplicate key value violates unique constraint "products_', {K}, '_pkey"')
    when {K} < 45 then concat('DETAIL:  Key (product_id)=(', {K} * 20 + 3, ') already exists.')
    when {K} < 55 then 'ValueException:'
    when {K} < 65 then concat('Caused by: connection refused on port ', {K})
    when {K} < 75 then concat('product_id : ', {K} * 7)
    when {K} < 85 then concat('ERROR in chunk ', {K}, ' - not all arguments converted')
    else concat('retry ', {K}) end"""

LINES_SQL = f"""lines as (select user_id, cast(ts as date) as day, event_id, {strip_sql(LINE)} as line
    from events)"""


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``user_id`` names the log, the day is its block, the event id orders lines."""
    return table(spark, folder, "events").select(
        "user_id",
        F.to_date("ts").alias("day"),
        "event_id",
        F.expr(LINE).alias("line"),
    )


HEADER = r"\A\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\]\s+`([A-Z]+)`\s+-\s+(.*)"
RECORDS_SQL = f"""{LINES_SQL}, marked as (select *, regexp_matches(line, '{HEADER}') as is_header
    from lines where line <> ''),
    numbered as (select *, sum(is_header::int) over (partition by user_id order by event_id)::bigint
        as record_no from marked),
    records as (select user_id, record_no, max(line) filter (is_header) as header,
        min(event_id) filter (is_header) as header_pos,
        coalesce(string_agg(line, chr(10) order by event_id) filter (not is_header), '') as traceback
        from numbered where record_no > 0 group by 1, 2)"""


def numbered(spark: SparkSession, folder: str) -> DataFrame:
    return logs.numbered_records(event_lines(spark, folder), ["user_id"], "day", "event_id")


@query(
    "FIL-08",
    f"with {RECORDS_SQL} select user_id, event_id, record_no, is_header, line from numbered where record_no > 0",
)
def numbered_lines(spark, folder):
    return numbered(spark, folder).select("user_id", "event_id", "record_no", "is_header", "line")


@query("WIN-03", f"with {RECORDS_SQL} select * from records")
def folded_records(spark, folder):
    rows = numbered(spark, folder)
    return logs.fold_records(rows, ["user_id"], "day", "event_id")


BODY = f"regexp_extract(header, '{HEADER}', 3)"
PARSED_SQL = f"""{RECORDS_SQL}, parsed as (select *,
    regexp_extract(header, '{HEADER}', 1) as timestamp, regexp_extract(header, '{HEADER}', 2) as level,
    trim(regexp_replace(regexp_replace({BODY}, '\\s+source=\\S+', '', 'g'), '\\s+loc=\\S+', '', 'g')) as message,
    regexp_extract({BODY}, 'source=([\\w.]+)', 1) as source, regexp_extract({BODY}, 'loc=(\\S+)', 1) as loc
    from records)"""
EVENT_SQL = """case when contains(m, 'sla miss detected') then 'SLA_MISS'
    when contains(m, 'failure detected') then 'FAILURE_TRIGGER'
    when contains(m, 'autorca') then 'AUTORCA' when contains(m, 'task failed') then 'TASK_ERROR'
    when contains(t, 'uniqueviolation') then 'DB_DUPLICATE_KEY'
    when contains(t, 'not all arguments') then 'DB_TYPE_ERROR'
    when contains(m, 'task instance is in running') then 'TASK_START'
    when contains(m, 'task instance in failure') then 'TASK_END_FAILURE'
    when contains(m, 'inserted') then 'INSERT_SUCCESS'
    when contains(m, 'read') and contains(m, 'rows') then 'DATA_READ'
    when contains(m, 'exported') then 'EXPORT' when level in ('ERROR', 'WARNING') then level
    else 'INFO' end"""


@query(
    "LOG-01",
    f"with {PARSED_SQL} select user_id, record_no, timestamp, level, message, source, loc from parsed",
)
def parsed_records(spark, folder):
    folded = logs.fold_records(numbered(spark, folder), ["user_id"], "day", "event_id")
    return logs.parse_records(folded).select(
        "user_id", "record_no", "timestamp", "level", "message", "source", "loc"
    )


CLASSIFIED_SQL = f"""{PARSED_SQL}, classified as (select *, {EVENT_SQL} as event_type
    from (select *, lower(message) as m, lower(traceback) as t from parsed))"""


@query(
    "LOG-02 LOG-01 WIN-03 FIL-08",
    f"with {CLASSIFIED_SQL} select user_id, record_no, level, event_type, message, traceback from classified",
)
def classified_events(spark, folder):
    events = logs.log_events(event_lines(spark, folder), ["user_id"], "day", "event_id")
    return events.select("user_id", "record_no", "level", "event_type", "message", "traceback")


# ------------------------------------------------------------------- chat as a log
TURNS_SQL = f"""turns as (select conv_id, turn, role = 'user' as is_header, {strip_sql('text')} as line
    from conversations where {strip_sql('text')} <> ''),
    numbered_turns as (select *, sum(is_header::int) over (partition by conv_id order by turn)::bigint
        as record_no from turns)"""


@query(
    "FIL-08 WIN-03",
    f"with {TURNS_SQL} select conv_id, record_no, max(line) filter (is_header) as header, "
    "coalesce(string_agg(line, chr(10) order by turn) filter (not is_header), '') as traceback "
    "from numbered_turns where record_no > 0 group by 1, 2",
)
def folded_conversations(spark, folder):
    turns = table(spark, folder, "conversations").withColumn("block", F.floor(F.col("turn") / 1000))
    rows = logs.numbered_records(
        turns, ["conv_id"], "block", "turn", "text", F.col("role") == "user"
    )
    folded = logs.fold_records(rows, ["conv_id"], "block", "turn", "text")
    return folded.select("conv_id", "record_no", "header", "traceback")


# ----------------------------------------------------------------- error evidence
READABLE_SQL = f"""{LINES_SQL}, readable as (select user_id, event_id, day,
    case when line like '{{%' then '[' || upper(coalesce(json_extract_string(line, '$.level'), 'info')) || '] '
         || coalesce(json_extract_string(line, '$.event'), '') else line end as line
    from lines where line <> '')"""


def readable(spark: SparkSession, folder: str) -> DataFrame:
    lines = event_lines(spark, folder).withColumn("line_pos", F.col("event_id"))
    return task_logs.json_log_lines(lines)


@query("SRC-04", f"with {READABLE_SQL} select user_id, event_id, line from readable")
def json_log_lines(spark, folder):
    return readable(spark, folder).select("user_id", "event_id", "line")


def _first_sql(patterns: list[str], group: int, text: str = "content") -> str:
    tests = [
        f"when regexp_matches({text}, '(?i){p}') then regexp_extract({text}, '(?i){p}', {group})"
        for p in patterns
    ]
    return f"case {' '.join(tests)} end"


_PHRASES = " ".join(
    f"when contains(lower(content), '{phrase.lower()}') then '{name}'"
    for phrase, name in rules.ERROR_PHRASES
)
_WORD_TEST = " or ".join(f"contains(lower(x), '{w}')" for w in rules.ERROR_LINE_WORDS)
EVIDENCE_SQL = f"""{READABLE_SQL}, whole as (select user_id, string_agg(line, chr(10) order by event_id)
    as content from readable group by 1),
    found as (select user_id, case {_PHRASES} else 'Unknown' end as error_type,
        coalesce(substring(trim({_first_sql(rules.ERROR_MESSAGE_PATTERNS, 0)}), 1, 300),
            list_filter(string_split(content, chr(10)), lambda x: {_WORD_TEST})[1], 'Unknown') as error_message,
        {_first_sql(rules.PRODUCT_ID_PATTERNS, 1)} as product_id,
        case when contains(content, 'Traceback') then
            substring(content, position('Traceback' in content), 2000) else '' end as traceback,
        nullif(regexp_extract(content, '{rules.ISO_TIMESTAMP_PATTERN}', 1), '') as execution_time
        from whole)"""


def user_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.error_evidence(readable(spark, folder), ["user_id"], "day", "line_pos")


@query("LOG-03 LOG-04 LOG-05 LOG-06 LOG-07 JON-09", f"with {EVIDENCE_SQL} select * from found")
def error_evidence(spark, folder):
    return user_evidence(spark, folder)


@query(
    "LOG-06",
    f"with {EVIDENCE_SQL} select user_id, traceback from found where traceback <> ''",
)
def tracebacks(spark, folder):
    return evidence.log_traceback(readable(spark, folder), ["user_id"], "day", "line_pos")


@query(
    "JON-09",
    f"with {LINES_SQL} select event_id, case {_PHRASES} else 'Unknown' end as error_type "
    "from (select event_id, line as content from lines)",
)
def matched_keywords(spark, folder):
    lines = event_lines(spark, folder).withColumn("line", strip(F.col("line")))
    return evidence.match_keyword(lines, "line").select("event_id", "error_type")


@query(
    "LOG-09",
    f"""with {LINES_SQL} select event_id, case
        when regexp_matches(line, '{rules.CONSTRAINT_PATTERNS[0].replace("'", "''")}')
        then regexp_extract(line, '{rules.CONSTRAINT_PATTERNS[0].replace("'", "''")}', 1)
        when regexp_matches(line, '{rules.CONSTRAINT_PATTERNS[1].replace("'", "''")}')
        then regexp_extract(line, '{rules.CONSTRAINT_PATTERNS[1].replace("'", "''")}', 1)
        else 'Unknown' end as constraint_name from lines""",
)
def constraint_names(spark, folder):
    return event_lines(spark, folder).select(
        "event_id", report.constraint_name(F.col("line")).alias("constraint_name")
    )


@query(
    "AGG-15",
    "select user_id, count(*) filter (contains(line, 'Out of memory') or contains(line, 'oom-killer')) "
    "as oom_count, oom_count > 0 as oom_detected from (select user_id, case when event_type = 'error' "
    "then 'Out of memory: killed ' || props when event_type = 'click' then 'oom-killer ' || props "
    "else 'out of memory' end as line from events where event_type <> 'purchase') group by 1",
)
def oom_counts(spark, folder):
    events = table(spark, folder, "events").where(F.col("event_type") != "purchase")
    lines = events.select(
        "user_id",
        F.when(F.col("event_type") == "error", F.concat(F.lit("Out of memory: killed "), "props"))
        .when(F.col("event_type") == "click", F.concat(F.lit("oom-killer "), "props"))
        .otherwise("out of memory").alias("line"),
    )
    return logs.oom_events(lines, ["user_id"])


# ------------------------------------------------------------------- log selection
def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """A log file per user and day; the files of purchases are named by the task."""
    events = table(spark, folder, "events")
    task = F.concat(F.lit("task_"), F.col("user_id").cast("string"))
    day = F.date_format("ts", "yyyy-MM-dd")
    stray = F.col("event_type") == "purchase"
    return events.select(
        F.when(stray, F.concat(F.lit("/logs/stray/"), task, F.lit("-"), day, F.lit(".log")))
        .otherwise(F.concat_ws("/", F.lit("/logs/dag_id=d"), F.concat(F.lit("run_id="), day),
                               F.concat(F.lit("task_id="), task), F.lit("attempt=1.log")))
        .alias("path"),
        F.when(stray, "").otherwise("d").alias("dag_id"),
        F.when(stray, "").otherwise(day).alias("run_id"),
        F.when(stray, "").otherwise(task).alias("task_id"),
        F.col("ts").alias("modified"),
    ).groupBy("path", "dag_id", "run_id", "task_id").agg(F.max("modified").alias("modified"))


FILES_SQL = """files as (select case when stray then '/logs/stray/' || task || '-' || day || '.log'
        else '/logs/dag_id=d/run_id=' || day || '/task_id=' || task || '/attempt=1.log' end as path,
        case when stray then '' else day end as run_id, case when stray then '' else task end as task_id,
        max(ts) as modified from (select *, event_type = 'purchase' as stray, 'task_' || user_id as task,
        strftime(ts, '%Y-%m-%d') as day from events) group by 1, 2, 3),
    asked as (select 'd' as dag_id, 'task_' || c_custkey as task_id,
        case when c_nationkey < 12 then '2024-01-09' else 'later' end as run_id from customer),
    options as (
        select a.*, 1 as tier, path, modified from asked a join files f
            on f.task_id = a.task_id and f.run_id = a.run_id and f.run_id <> ''
        union all select a.*, 2, path, modified from asked a join files f
            on f.task_id = a.task_id and f.run_id <> ''
        union all select a.*, 3, path, modified from asked a join files f
            on starts_with(regexp_extract(path, '([^/]*)$', 1), a.task_id) and f.run_id = '')"""


@query(
    "WIN-02",
    f"with {FILES_SQL} select a.dag_id, a.task_id, a.run_id, o.path, o.tier::bigint as tier "
    "from asked a left join (select * from options qualify row_number() over (partition by task_id "
    "order by tier, modified desc, path desc) = 1) o using (dag_id, task_id, run_id)",
)
def latest_logs(spark, folder):
    triggers = table(spark, folder, "customer").select(
        F.lit("d").alias("dag_id"),
        F.concat(F.lit("task_"), F.col("c_custkey").cast("string")).alias("task_id"),
        F.when(F.col("c_nationkey") < 12, "2024-01-09").otherwise("later").alias("run_id"),
    )
    return evidence.latest_log(log_files(spark, folder), triggers)


@query(
    "LOG-08",
    """select 'd' as dag_id, 'task_' || user_id as task_id, 'SLAMiss' as error_type,
        'Task ''task_' || user_id || ''' in DAG ''d'' exceeded its configured SLA threshold. '
        || 'Task did not complete within the allowed time window.' as error_message,
        substr(ts::varchar, 1, 19) as execution_time, false as log_found, event_id::varchar as run_ref
        from events where event_type = 'click'""",
)
def sla_evidence(spark, folder):
    events = table(spark, folder, "events")
    triggers = events.select(
        F.lit("d").alias("dag_id"),
        F.concat(F.lit("task_"), F.col("user_id").cast("string")).alias("task_id"),
        F.when(F.col("event_type") == "click", rules.SLA_RUN_ID).otherwise("manual").alias("run_id"),
        F.concat_ws("|", F.substring(F.col("ts").cast("string"), 1, 19), "event_id").alias("execution_date"),
    )
    found = evidence.sla_evidence(triggers)
    return found.select(
        "dag_id", "task_id", "error_type", "error_message", "log_found",
        F.split("execution_time", r"\|")[0].alias("execution_time"),
        F.split("execution_time", r"\|")[1].alias("run_ref"),
    )


# --------------------------------------------------------------------- log folders
def written_logs(spark: SparkSession, folder: str) -> str:
    """The event lines as a tree of key=value folders, one run per day."""
    root = fresh_folder(spark, "logs")
    lines = event_lines(spark, folder)
    lines.select(
        F.lit("d").alias("dag_id"),
        F.concat(F.lit("manual__"), F.date_format("day", "yyyy-MM-dd"), F.lit("T00:00:00+00:00")).alias("run_id"),
        F.lit("load").alias("task_id"),
        F.struct("event_id").alias("at"),
        "line",
    ).repartition("run_id").sortWithinPartitions("run_id", "at").select(
        "line", "dag_id", "run_id", "task_id"
    ).write.partitionBy("dag_id", "run_id", "task_id").text(root)
    return root


@query(
    "SRC-03",
    f"with {LINES_SQL} select 'd' as dag_id, 'manual__' || day || 'T00:00:00+00:00' as run_id, "
    "'load' as task_id, '' as attempt, count(*) as lines, count(*) filter (line <> '') as filled, "
    "sum(length(line))::bigint as characters from lines group by day",
)
def task_log_files(spark, folder):
    rows = task_logs.read_task_logs(spark, written_logs(spark, folder))
    text = strip(F.col("line"))
    return rows.groupBy("dag_id", "run_id", "task_id", "attempt").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(text != "").alias("filled"),
        F.sum(F.length(text)).alias("characters"),
    )


@query(
    "SRC-03",
    f"with {LINES_SQL} select 'd' as dag_id, 'manual__' || day || 'T00:00:00+00:00' as run_id, 'load' as task_id, "
    "line from lines where day = (select min(day) from lines)",
)
def one_run_log(spark, folder):
    """The log of the first day: the folders of the other days are not read."""
    day = event_lines(spark, folder).agg(F.date_format(F.min("day"), "yyyy-MM-dd")).first()[0]
    run = f"manual__{day}T00:00:00+00:00"
    rows = task_logs.read_task_logs(spark, written_logs(spark, folder), dag_id="d", run_id=run)
    return rows.select("dag_id", "run_id", "task_id", strip(F.col("line")).alias("line"))


_PER_DAY = ("user_id, cast(ts as date) as day", "cast(ts as date) as user_id, 0 as day")
DAY_EVIDENCE_SQL = EVIDENCE_SQL.replace(*_PER_DAY)


@query(
    "SRC-03 SRC-04 WIN-02 LOG-03 LOG-04 LOG-05 LOG-06 LOG-07 LOG-08",
    f"""with {DAY_EVIDENCE_SQL}, days as (select user_id as day, * exclude (user_id), 'manual__' || user_id
        || 'T00:00:00+00:00' as run from (select distinct user_id from lines) left join found using (user_id))
    select day::varchar as execution_date, 'load' as task_id, run as run_id, true as log_found, error_type,
        error_message, product_id, traceback, execution_time from days
    union all select day::varchar, 'load', '{rules.SLA_RUN_ID}', false, 'SLAMiss',
        'Task ''load'' in DAG ''d'' exceeded its configured SLA threshold. '
        || 'Task did not complete within the allowed time window.', null, '', day::varchar from days
    union all select day::varchar, 'gone', run, false, 'Unknown', 'No log content available', null, '', null
        from days""",
)
def log_evidence(spark, folder):
    """Each day is triggered as a run with a log, as an SLA miss, and as a task without a log."""
    triggers = day_triggers(spark, folder)
    return evidence.tree_log_evidence(spark, triggers, written_logs(spark, folder)).drop("dag_id", "status")


def day_triggers(spark, folder):
    day = F.date_format("day", "yyyy-MM-dd")
    run = F.concat(F.lit("manual__"), day, F.lit("T00:00:00+00:00"))
    asked = [("load", run), ("load", F.lit(rules.SLA_RUN_ID)), ("gone", run)]
    return event_lines(spark, folder).select("day").distinct().select(
        F.lit("d").alias("dag_id"),
        day.alias("execution_date"),
        F.inline(F.array(*[F.struct(F.lit(t).alias("task_id"), r.alias("run_id")) for t, r in asked])),
    )


@query(
    "WIN-02 SRC-03",
    f"""with {LINES_SQL}, days as (select day, count(*) as lines, sum(length(line))::bigint as characters from lines
        where day in (select day from lines group by day order by day limit 3) group by day)
    select 'manual__' || day || 'T00:00:00+00:00' as run_id, 'load' as task_id, 1::bigint as tier, lines,
        characters from days
    union all select 'manual__' || day || 'T00:00:00+00:00', 'gone', null, 0, 0 from days""",
)
def selected_logs(spark, folder):
    """Three days are triggered, each with and without a log: the other days' files stay closed."""
    triggers = day_triggers(spark, folder)
    days = triggers.select("execution_date").distinct().orderBy("execution_date").limit(3)
    chosen, lines = evidence.selected_logs(
        spark, triggers.join(days, "execution_date"), written_logs(spark, folder)
    )
    found = lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length(strip(F.col("line")))).alias("characters")
    )
    counts = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("lines", "characters")}
    return chosen.join(found, "path", "left").select("run_id", "task_id", "tier", "lines", "characters").withColumns(
        counts
    )


DAY_EVENTS_SQL = CLASSIFIED_SQL.replace("user_id, cast(ts as date) as day", "cast(ts as date) as user_id, 0 as day")


@query(
    "SNK-06 SRC-03 WIN-03 LOG-01 LOG-02",
    f"with {DAY_EVENTS_SQL} select 'd' as dag_id, 'manual__' || user_id || 'T00:00:00+00:00' as run_id, "
    "'load' as task_id, '' as attempt, timestamp, level, event_type, message, source, loc, traceback "
    "from classified",
)
def exported_log_events(spark, folder):
    events = file_events(task_logs.read_task_logs(spark, written_logs(spark, folder)))
    path = fresh_folder(spark, "log-events")
    sinks.write_log_events(events, path, "parquet")
    return spark.read.parquet(path)
