"""Incidents: evidence joined per customer, scored, and summarised.

Every customer is one run.  Its log, audit and host are those of the user of the same
number, its load is its orders, its stored report is made from the conversation of
the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import health, loads, logs
from bindings.common import Registry, fresh_folder, table
from faultline import rules
from faultline.operators import evidence as ev
from faultline.operators import loads as load_ops
from faultline.operators import rca, report
from faultline.plans.incident import analyse, store_evidence, summarise

REGISTRY = Registry()
query = REGISTRY.query
KEY = load_ops.RUN_KEY


def key_of(number) -> list:
    return [
        F.lit("d").alias("dag_id"),
        F.concat(F.lit("task_"), number.cast("string")).alias("task_id"),
        F.concat(F.lit("run_"), number.cast("string")).alias("run_id"),
    ]


# -------------------------------------------------------------------------- reports
def reports(spark: SparkSession, folder: str) -> DataFrame:
    """A tagged report text per conversation: its first turn is the summary, all others the cause."""
    turns = table(spark, folder, "conversations")
    step = F.concat(
        (F.col("turn") + 1).cast("string"), F.when(F.col("turn") % 2 == 0, ". ").otherwise(") "),
        F.lit("ask the "), F.col("role"),
    )
    steps = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("turn", step.alias("step")))), lambda x: x["step"]
        ),
        "\n",
    )

    later = F.sort_array(F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", "text"))))
    grouped = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).cast("string").alias("n"),
        steps.alias("steps"),
        F.coalesce(F.max(F.when(F.col("turn") == 0, F.col("text"))), F.lit("")).alias("first"),
        F.array_join(F.transform(later, lambda x: x["text"]), "\n").alias("later"),
        F.max(F.when(F.col("role") == "system", "yes")).alias("system"),
    )
    insights = F.concat(
        F.lit("CURRENT RUN STATUS:\n- Total records: "), F.col("n"),
        F.when(
            F.col("system").isNotNull(),
            F.concat(
                F.lit("\n\n HISTORICAL BENCHMARK COMPARISON:\n - Historical average throughput: "),
                F.col("n"), F.lit(" rows/sec\nnot a dash line\n- Performance gap: -"), F.col("n"),
                F.lit("% current run is faster\n- Trend: IMPROVING\nBOTTLENECK DETECTION:\n- none\n"
                      "Most successful historical fix: ask again"),
            ),
        ).otherwise(F.concat(F.lit("\n- it is slower than "), F.col("n"), F.lit("\nnothing else"))),
    )
    body = F.concat(
        F.lit("<summary>\n"), F.col("first"), F.lit("\n</summary><root_cause>"), F.col("later"),
        F.lit("</root_cause>\n<resolution>"), F.col("steps"), F.lit("</resolution><performance_insights>"),
        insights, F.lit("</performance_insights><sla_analysis>\n\nover by "), F.col("n"),
        F.lit("\n second \n\nthird\nfourth\nfifth</sla_analysis>"),
        F.when(F.col("n").cast("int") > 5, F.lit("<preventive_actions>1. test</preventive_actions>"))
        .otherwise(F.lit("")),
    )
    return grouped.select("conv_id", body.alias("response_text"))


REPORTS_SQL = """grouped as (select conv_id, count(*)::varchar as n,
        string_agg((turn + 1) || case when turn % 2 = 0 then '. ' else ') ' end || 'ask the ' || role,
            chr(10) order by turn) as steps,
        coalesce(max(text) filter (turn = 0), '') as first, coalesce(string_agg(text, chr(10) order by turn, text) filter (turn > 0), '') as later,
        max(case when role = 'system' then 'yes' end) as system from conversations group by 1),
    texts as (select conv_id, E'<summary>\\n' || first || E'\\n</summary><root_cause>' || later
        || E'</root_cause>\\n<resolution>' || steps || '</resolution><performance_insights>'
        || E'CURRENT RUN STATUS:\\n- Total records: ' || n || case when system is not null then
            E'\\n\\n HISTORICAL BENCHMARK COMPARISON:\\n - Historical average throughput: ' || n
            || E' rows/sec\\nnot a dash line\\n- Performance gap: -' || n
            || E'% current run is faster\\n- Trend: IMPROVING\\nBOTTLENECK DETECTION:\\n- none\\n'
            || 'Most successful historical fix: ask again'
            else E'\\n- it is slower than ' || n || E'\\nnothing else' end
        || E'</performance_insights><sla_analysis>\\n\\nover by ' || n
        || E'\\n second \\n\\nthird\\nfourth\\nfifth</sla_analysis>'
        || case when n::int > 5 then '<preventive_actions>1. test</preventive_actions>' else '' end
        as response_text from grouped),
    sections as (select *, """ + ", ".join(
    f"trim(regexp_extract(response_text, '(?s)<{tag}>(.*?)</{tag}>', 1), ' ' || chr(10)) as {tag}"
    for tag in rules.REPORT_TAGS
) + " from texts)"


@query(
    "RCA-04",
    f"with {REPORTS_SQL} select conv_id, {', '.join(rules.REPORT_TAGS)} from sections",
)
def report_sections(spark, folder):
    return rca.report_sections(reports(spark, folder)).drop("response_text")


def _steps_sql(column: str, defaults: list[str], padding: str) -> str:
    quoted = ", ".join(f"'{x}'" for x in defaults)
    listed = (
        f"list_transform(list_filter(list_transform(string_split({column}, chr(10)), lambda x: trim(x)), "
        f"lambda x: regexp_matches(x, '^\\d+[.)]')), lambda x: regexp_replace(x, '^\\d+[.)]\\s*', ''))"
    )
    padded = f"list_slice(list_concat({listed}, ['{padding}', '{padding}', '{padding}']), 1, 3)"
    return f"array_to_string(case when {column} = '' then [{quoted}] else {padded} end, '|')"


RESOLUTION_SQL = _steps_sql("resolution", rules.RESOLUTION_DEFAULTS, rules.RESOLUTION_PADDING)
PREVENTION_SQL = _steps_sql("preventive_actions", rules.PREVENTION_DEFAULTS, rules.PREVENTION_PADDING)


@query(
    "RPT-01",
    f"with {REPORTS_SQL} select conv_id, {RESOLUTION_SQL} as resolution_steps, "
    f"{PREVENTION_SQL} as preventive_steps from sections",
)
def report_steps(spark, folder):
    rows = rca.report_sections(reports(spark, folder))
    return rows.select(
        "conv_id",
        F.array_join(report.resolution_steps(F.col("resolution")), "|").alias("resolution_steps"),
        F.array_join(report.preventive_steps(F.col("preventive_actions")), "|").alias("preventive_steps"),
    )


SECTION_SQL = """case when system is not null then '- Historical average throughput: ' || n
    || ' rows/sec|- Performance gap: -' || n || '% current run is faster|- Trend: IMPROVING' else '' end"""


@query(
    "RPT-04",
    f"""with {REPORTS_SQL} select conv_id, {SECTION_SQL} as section_lines,
        case when system is not null then {SECTION_SQL} else '- it is slower than ' || n end as comparison_lines,
        case when system is not null then 'Most successful historical fix: ask again' end as best_fix_line,
        'over by ' || n || '|second|third|fourth' as first_lines
    from sections join grouped using (conv_id)""",
)
def report_lines(spark, folder):
    rows = rca.report_sections(reports(spark, folder))
    insights = F.col("performance_insights")
    return rows.select(
        "conv_id",
        F.array_join(report.section_lines(insights), "|").alias("section_lines"),
        F.array_join(report.comparison_lines(insights), "|").alias("comparison_lines"),
        report.best_fix_line(insights).alias("best_fix_line"),
        F.array_join(report.first_lines(F.col("sla_analysis")), "|").alias("first_lines"),
    )


# ------------------------------------------------------------------------- evidence
def triggers(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventeenth analysis has crashed."""
    customer = F.col("c_custkey")
    return table(spark, folder, "customer").select(*key_of(customer), (customer % 17 == 0).alias("crashed"))


def log_rows(spark: SparkSession, folder: str) -> DataFrame:
    found = logs.user_evidence(spark, folder)
    failed = F.col("user_id") % 13 == 0
    return found.select(
        *key_of(F.col("user_id")),
        F.when(failed, "ERROR").otherwise("SUCCESS").alias("status"),
        F.when(failed, F.concat(F.lit("log of "), F.col("user_id").cast("string"))).alias("message"),
        "error_type", "error_message", "product_id",
    )


def gathered(spark: SparkSession, folder: str) -> dict:
    """All evidence, each kind computed once; that of products follows that of logs."""
    store = fresh_folder(spark, "evidence")
    audits = loads.latest_audits(spark, folder).withColumn(
        "task_id", F.concat(F.lit("task_"), F.col("task_id").cast("string"))
    )
    history = table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("incidents_found"),
        (F.count_if(F.col("role") == "system") > 0).alias("has_benchmarks"),
    )
    hosts = health.overall(spark, folder)
    runtime = health.runtime(spark, folder).groupBy("datname").agg(
        F.max_by("health", "snapshot_ts").alias("health"), F.lit(True).alias("has_counters")
    )
    perf = rca.run_metrics(loads.breached(spark, folder))
    ok = F.lit("SUCCESS").alias("status")
    kinds = {
        "log": (log_rows(spark, folder), KEY),
        "audit": (audits, ["dag_id", "task_id"]),
        "history": (
            history.select(
                *key_of(F.col("conv_id")), ok, "incidents_found", "has_benchmarks",
                F.concat(F.lit("INC"), F.col("conv_id").cast("string")).alias("top_match_id"),
            ),
            KEY,
        ),
        "host": (
            hosts.select(
                *key_of(F.col("host")), ok, "overall_health",
                *[F.col("overall_health").alias(c) for c in ("cpu_health", "memory_health", "postgres_health")],
            ),
            KEY,
        ),
        "runtime": (runtime.select(*key_of(F.col("datname")), ok, "health", "has_counters"), KEY),
        "perf": (
            perf.select(*key_of(F.col("run_id")), *[c for c in perf.columns if c not in KEY]), KEY
        ),
    }
    found = store_evidence(kinds, store)
    product = load_ops.product_check(
        loads.products(spark, folder), found["log"][0].select(*KEY, "product_id"), F.xxhash64("run_id")
    ).withColumn("status", F.lit("SUCCESS"))
    shown = product.select(*KEY, "status", "product_name", "exists", "duplicate_detected")
    return found | store_evidence({"product": (shown, KEY)}, store)


ASSEMBLED_SQL = f"""{logs.EVIDENCE_SQL}, {loads.AUDIT_SQL}, {loads.CHUNKS_SQL},
    {health.OVERALL_SQL}, {health.RUNTIME_SQL}, {REPORTS_SQL},
    log_ as (select *, case when user_id % 13 = 0 then 'ERROR' else 'SUCCESS' end as status from found),
    history_ as (select conv_id, count(*) as incidents_found, count(*) filter (role = 'system') > 0 as has_benchmarks
        from conversations group by 1),
    runtime_ as (select datname, last(health order by snapshot_ts) as health from runtime group by 1),
    assembled as (select c_custkey as n, l.status as log_status, l.error_type, l.error_message, l.product_id,
        a.status as audit_status_, a.audit_status, a.error_message as audit_message,
        case when l.user_id is null then 'MISSING' else 'SUCCESS' end as product_status,
        p_partkey is not null as product_exists, p_name as product_name,
        case when h.conv_id is null then 'MISSING' else 'SUCCESS' end as history_status,
        coalesce(incidents_found, 0) as incidents_found, coalesce(has_benchmarks, false) as has_benchmarks,
        case when o.host is null then 'MISSING' else 'SUCCESS' end as host_status,
        coalesce(overall_health, 'UNKNOWN') as overall_health,
        case when r.datname is null then 'MISSING' else 'SUCCESS' end as runtime_status,
        coalesce(r.health, 'UNKNOWN') as runtime_health, b.rows_inserted, b.total_rows, b.run_id is not null as has_perf,
        b.pct_complete, b.elapsed_seconds, b.rows_per_second, b.eta_seconds, b.sla_threshold,
        response_text
        from customer left join log_ l on l.user_id = c_custkey left join audits a on a.task_id = c_custkey
        left join part on p_partkey = try_cast(l.product_id as bigint)
        left join history_ h on h.conv_id = c_custkey left join overall o on o.host = c_custkey
        left join runtime_ r on r.datname = c_custkey left join breaches b on b.run_id = c_custkey
        left join texts t on t.conv_id = c_custkey)"""


def assembled(spark: SparkSession, folder: str) -> DataFrame:
    return rca.assemble(triggers(spark, folder), gathered(spark, folder))


@query(
    "JON-06 SET-03",
    f"""with {ASSEMBLED_SQL} select 'run_' || n as run_id, coalesce(log_status, 'MISSING') as log_status,
        error_type, audit_status_ as audit_status, product_status, product_exists, history_status, incidents_found,
        host_status, overall_health, runtime_status, runtime_health, rows_inserted,
        case when log_status = 'ERROR' then 'log: log of ' || n else '' end as errors from assembled""",
)
def assembled_evidence(spark, folder):
    return assembled(spark, folder).select(
        "run_id",
        F.col("log.status").alias("log_status"), F.col("log.error_type").alias("error_type"),
        F.col("audit.status").alias("audit_status"),
        F.col("product.status").alias("product_status"),
        F.coalesce("product.exists", F.lit(False)).alias("product_exists"),
        F.col("history.status").alias("history_status"),
        F.col("history.incidents_found").alias("incidents_found"),
        F.col("host.status").alias("host_status"),
        F.col("host.overall_health").alias("overall_health"),
        F.col("runtime.status").alias("runtime_status"),
        F.col("runtime.health").alias("runtime_health"),
        F.col("perf.rows_inserted").alias("rows_inserted"),
        F.array_join("errors", "; ").alias("errors"),
    )


CONFIDENCE_SQL = """least(100,
    case when log_status = 'SUCCESS' then 20 + case when error_type <> 'Unknown' then 10 else 0 end
        + case when product_id is not null then 10 else 0 end else 0 end
    + case when audit_status_ = 'SUCCESS' then 10 + case when audit_message <> '' then 10 else 0 end else 0 end
    + case when product_status = 'SUCCESS' then 10 + case when product_exists then 10 else 0 end else 0 end
    + case when history_status = 'SUCCESS' then case when incidents_found >= 2 then 20 else 10 end
        + case when has_benchmarks then 5 else 0 end else 0 end
    + case when host_status = 'SUCCESS' then 5 + case when overall_health in ('WARNING', 'CRITICAL') then 5 else 0 end
        else 0 end
    + case when coalesce(rows_inserted, 0) <> 0 then 5 else 0 end
    + case when runtime_status = 'SUCCESS' then 10 + case when runtime_health in ('WARNING', 'CRITICAL') then 5
        else 0 end else 0 end) / 100.0::double"""


@query(
    "RCA-01",
    f"with {ASSEMBLED_SQL} select 'run_' || n as run_id, {CONFIDENCE_SQL} as confidence from assembled",
)
def confidence_scores(spark, folder):
    return assembled(spark, folder).select("run_id", rca.confidence().alias("confidence"))


def analysed(spark: SparkSession, folder: str) -> DataFrame:
    stored = reports(spark, folder).select(
        *key_of(F.col("conv_id")), F.col("conv_id").alias("incident_id"), "response_text"
    )
    return analyse(triggers(spark, folder), gathered(spark, folder), stored)


STATUS_SQL = """case when log_status = 'ERROR' or response_text is null then 'PARTIAL' else 'SUCCESS' end"""


@query(
    "RCA-05 FIL-10",
    f"with {ASSEMBLED_SQL} select 'run_' || n as run_id, {STATUS_SQL} as workflow_status from assembled "
    "where n % 17 <> 0",
)
def incident_statuses(spark, folder):
    return rca.publishable(analysed(spark, folder)).select("run_id", "workflow_status")


@query(
    "RCA-05",
    f"with {ASSEMBLED_SQL} select case when n % 17 = 0 then 'FAILED' else {STATUS_SQL} end as workflow_status, "
    "count(*) as incidents from assembled group by 1",
)
def workflow_outcomes(spark, folder):
    return analysed(spark, folder).groupBy("workflow_status").agg(F.count(F.lit(1)).alias("incidents"))


_LATE = "(coalesce(error_type = 'SLAMiss', false) or contains(coalesce(error_message, ''), 'SLA'))"
_FAILED = "(coalesce(audit_status, '') = 'FAILED' or coalesce(audit_status_, '') = 'ERROR')"


def _impact_sql(place: int) -> str:
    late, failed, none = (
        x[place] for x in (rules.IMPACT_SLA, rules.IMPACT_FAILED, rules.IMPACT_NONE)
    )
    return (
        f"case when {_LATE} then '{late}' when {_FAILED} then '{failed}' "
        f"when audit_status_ = 'NO_FAILURE_FOUND' then '{none}' else '{failed}' end"
    )


@query(
    "RPT-02",
    f"with {ASSEMBLED_SQL} select 'run_' || n as run_id, {_impact_sql(0)} as product_load, "
    f"{_impact_sql(1)} as catalog_update, {_impact_sql(2)} as downstream_feeds from assembled",
)
def impacts(spark, folder):
    effect = report.impact(
        F.col("log.error_type"), F.col("log.error_message"), F.col("audit.audit_status"),
        F.col("audit.status"),
    )
    rows = assembled(spark, folder).withColumn("effect", effect)
    return rows.select("run_id", "effect.*")


CHECK_SQL = """case when error_type = 'SLAMiss' then case when has_perf
        then 'SLA Miss — ' || format('{:,}', total_rows) || ' rows being processed. No product lookup required.'
        else 'SLA Miss — no product lookup required.' end
    when product_exists then 'Product ID ' || product_id || ' exists — ' || product_name
    when product_status = 'SUCCESS' then 'Product ID ' || coalesce(product_id, 'None') || ' not found in product_master'
    else 'DB check unavailable' end"""
CLOSEST_SQL = """case when incidents_found > 0 then incidents_found || ' similar case(s) found — closest: INC' || n
    else 'No similar historical cases found' end"""


@query(
    "RPT-06",
    f"with {ASSEMBLED_SQL} select 'run_' || n as run_id, case when error_type = 'SLAMiss' then 'SLA_MISS' "
    "when product_exists then 'FOUND' when product_status = 'SUCCESS' then 'NOT_FOUND' else 'UNAVAILABLE' end "
    f"as check_outcome, {CHECK_SQL} as postgresql_check, {CLOSEST_SQL} as historical_cases from assembled",
)
def check_outcomes(spark, folder):
    outcome = report.check_outcome(
        F.col("log.error_type"), F.col("perf.total_rows"), F.col("product.exists"),
        F.col("product.product_name"), F.col("product.status"), F.col("log.product_id"),
    )
    return assembled(spark, folder).select(
        "run_id",
        *[value.alias(name) for name, value in outcome.items()],
        report.closest_case(F.col("history.incidents_found"), F.col("history.top_match_id")).alias(
            "historical_cases"
        ),
    )


_SEVERITY = " ".join(f"when '{k}' then '{v}'" for k, v in rules.SEVERITY.items())
SEVERITY_SQL = f"case error_type {_SEVERITY} else 'P3' end"


@query(
    "JON-10",
    f"select event_id, {SEVERITY_SQL} as severity, {SEVERITY_SQL} as joined_severity from "
    f"(select event_id, case {logs._PHRASES} else 'Unknown' end as error_type from "
    f"(with {logs.LINES_SQL} select event_id, line as content from lines))",
)
def severities(spark, folder):
    """By expression, and by a join with a severity table."""
    dim = spark.createDataFrame(
        [(k, v) for k, v in rules.SEVERITY.items()], "error_type string, severity string"
    )
    errors = ev.match_keyword(logs.event_lines(spark, folder), "line")
    joined = report.with_severity(errors, dim).withColumnRenamed("severity", "joined_severity")
    return joined.select(
        "event_id", report.severity(F.col("error_type")).alias("severity"), "joined_severity"
    )


def _safe_sql(x: str, n: int = 400) -> str:
    t = f"trim(coalesce({x}, ''), ' ' || chr(10))"
    return (
        f"case when {t} = '' then 'Unknown' when length({t}) > {n} "
        f"then rtrim(substring({t}, 1, {n - 3}), ' ' || chr(10)) || '...' else {t} end"
    )


def _step_sql(section: str, place: int) -> str:
    given = {
        "resolution": (rules.RESOLUTION_DEFAULTS, rules.RESOLUTION_PADDING),
        "preventive_actions": (rules.PREVENTION_DEFAULTS, rules.PREVENTION_PADDING),
    }[section]
    return f"string_split({_steps_sql(f"coalesce({section}, '')", *given)}, '|')[{place}]"


_CONSTRAINTS = [p.replace("'", "''") for p in rules.CONSTRAINT_PATTERNS]
CONSTRAINT_SQL = "case " + " ".join(
    f"when regexp_matches(error_message, '{p}') then regexp_extract(error_message, '{p}', 1)" for p in _CONSTRAINTS
) + " else 'Unknown' end"
GRADES_SQL = ", ".join(f"case when host_status = 'SUCCESS' then overall_health end as {c}" for c in report.GRADES)
INSIGHTS_SQL = """case when conv_id is null then 'Unknown' when (select g.system from grouped g
        where g.conv_id = joined.conv_id) is not null then '- Historical average throughput: ' || lines_
        || E' rows/sec\\n- Performance gap: -' || lines_ || E'% current run is faster\\n- Trend: IMPROVING\\n'
        || 'Most successful historical fix: ask again' else '- it is slower than ' || lines_ end"""


@query(
    "RPT-07 RPT-01 RPT-02 RPT-06 JON-06 JON-10",
    f"""with {ASSEMBLED_SQL}, joined as (select a.*, s.* exclude (response_text),
            {CONFIDENCE_SQL} as confidence_, (select g.n from grouped g where g.conv_id = s.conv_id) as lines_
            from assembled a left join sections s on s.conv_id = a.n)
    select {_safe_sql('conv_id::varchar')} as incident_id, 'd' as dag, 'task_' || n as task,
        {SEVERITY_SQL} as severity,
        case when conv_id is not null then 'Confirmed' else 'Under Investigation' end as status,
        confidence_::varchar as confidence, {_safe_sql('error_message')} as error,
        {_safe_sql('product_id')} as product_id, {_safe_sql('root_cause')} as cause,
        {CHECK_SQL} as postgresql_check, {CLOSEST_SQL} as historical_cases,
        {_impact_sql(0)} as product_load,
        case when conv_id is null then 'SLA analysis not available'
            else 'over by ' || (select g.n from grouped g where g.conv_id = joined.conv_id) || ' | second | third | fourth'
            end as sla_analysis,
        {_impact_sql(1)} as catalog_update, {_impact_sql(2)} as downstream_feeds,
        {CONSTRAINT_SQL} as "constraint", {_safe_sql('error_message')} as airflow_logs, 
        case when host_status = 'SUCCESS' then overall_health else 'UNKNOWN' end as system_health,
        {INSIGHTS_SQL} as performance_insights, rows_inserted, total_rows::bigint as total_rows, pct_complete,
        elapsed_seconds, rows_per_second, eta_seconds, sla_threshold::bigint as sla_threshold,
        round(elapsed_seconds - sla_threshold, 1) as sla_breach_by, {GRADES_SQL}, runtime_health,
        {_step_sql('resolution', 1)} as remove_duplicate_record, {_step_sql('resolution', 2)} as reload_source_file,
        {_step_sql('resolution', 3)} as rerun_dag, {_step_sql('preventive_actions', 1)} as prevention_high_1,
        {_step_sql('preventive_actions', 2)} as prevention_high_2,
        {_step_sql('preventive_actions', 3)} as prevention_medium_1,
        {_safe_sql('summary', 900)} as final_verdict
    from joined where n % 17 <> 0""",
)
def incident_summaries(spark, folder):
    return summarise(analysed(spark, folder))
