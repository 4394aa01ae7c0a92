"""Health over ``events``: sessions, locks, counters and host samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.common import Registry, table
from faultline.operators import database as d
from faultline.operators import host
from faultline.plans import evidence

REGISTRY = Registry()
query = REGISTRY.query

STATE = """case event_type when 'view' then 'active' when 'error' then 'active' when 'click' then 'idle'
    when 'purchase' then 'idle in transaction' end"""
TEXT = "case when event_type = 'signup' then '' else concat('select ', props) end"


# -------------------------------------------------------------------------- sessions
def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """A session per event in the snapshot taken at the end of its hour."""
    events = table(spark, folder, "events")
    return events.select(
        (F.date_trunc("hour", "ts") + F.expr("interval 1 hour")).cast("timestamp_ntz").alias("snapshot_ts"),
        F.col("event_id").alias("pid"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("usename"),
        F.expr(STATE).alias("state"),
        F.expr(TEXT).alias("query"),
        F.when(F.col("value") > 10, F.col("ts")).alias("query_start"),
        F.col("ts").alias("xact_start"),
    )


SESSIONS_SQL = f"""sessions as (select date_trunc('hour', ts) + interval 1 hour as snapshot_ts, event_id as pid,
    'user_' || user_id as usename, {STATE} as state, {TEXT} as query,
    case when value > 10 then ts end as query_start, ts as xact_start from events)"""
_AGE = "(epoch_us(snapshot_ts) - epoch_us(query_start)) / 1000000.0::double"


def shown():
    return F.date_format("snapshot_ts", "yyyy-MM-dd HH").alias("snapshot")


_SHOWN = "strftime(snapshot_ts, '%Y-%m-%d %H') as snapshot"


@query(
    "FIL-02",
    f"with {SESSIONS_SQL} select pid, usename, state, query from sessions "
    "where state is not null and query <> ''",
)
def live_sessions(spark, folder):
    return d.live_sessions(sessions(spark, folder)).select("pid", "usename", "state", "query")


@query(
    "FIL-03",
    f"with {SESSIONS_SQL} select pid, coalesce({_AGE}, 0) >= 1800 as is_slow from sessions",
)
def flagged_sessions(spark, folder):
    rows = d.session_durations(sessions(spark, folder), digits=6)
    return d.flag_slow(rows, 1800).select("pid", "is_slow")


@query("AGG-16", f"with {SESSIONS_SQL} select {_SHOWN}, count(*) filter ({_AGE} >= 1800) as slow_query_count "
       "from sessions group by snapshot_ts")
def slow_counts(spark, folder):
    rows = d.flag_slow(d.session_durations(sessions(spark, folder), digits=6), 1800)
    return d.slow_count(rows).select(shown(), "slow_query_count")


@query("FIL-04", f"with {SESSIONS_SQL} select pid from sessions where state = 'active' and {_AGE} > 1800")
def long_active(spark, folder):
    return d.long_active(sessions(spark, folder), 1800).select("pid")


@query(
    "SRT-03",
    f"with {SESSIONS_SQL} select pid, usename from sessions order by query_start nulls last, pid",
)
def ordered_sessions(spark, folder):
    return d.order_sessions(sessions(spark, folder)).select("pid", "usename")


@query(
    "AGG-05",
    f"with {SESSIONS_SQL} select {_SHOWN}, coalesce(state, 'unknown') as state, count(*) as sessions "
    "from sessions group by snapshot_ts, 2",
)
def sessions_by_state(spark, folder):
    return d.sessions_by_state(sessions(spark, folder)).select(shown(), "state", "sessions")


TOTALS_SQL = f"""{SESSIONS_SQL}, totals as (select snapshot_ts, count(*) as total_connections,
    count(*) filter (state = 'idle in transaction') as idle_in_transaction,
    count(*) * 100.0::double / 20 as connections_percent from sessions group by 1)"""


def totals(spark: SparkSession, folder: str) -> DataFrame:
    return d.saturation(d.session_totals(sessions(spark, folder)), F.lit(20), digits=None)


@query(
    "AGG-05 AGG-07",
    f"with {TOTALS_SQL} select {_SHOWN}, total_connections, idle_in_transaction, connections_percent from totals",
)
def connection_saturation(spark, folder):
    return totals(spark, folder).select(
        shown(), "total_connections", "idle_in_transaction", "connections_percent"
    )


# ----------------------------------------------------------------------------- locks
def locks(spark: SparkSession, folder: str) -> DataFrame:
    """Errors wait for a lock and purchases hold one, on the relation of their user;
    some relations and databases are null."""
    events = table(spark, folder, "events").where(F.col("event_type").isin("error", "purchase"))
    return events.select(
        F.to_date("ts").alias("snapshot_ts"),
        F.col("event_id").alias("pid"),
        F.when(F.col("value") > 300, "tuple").otherwise("relation").alias("locktype"),
        F.when(F.col("user_id") % 7 == 0, None).otherwise(F.col("user_id") % 3).alias("database"),
        F.when(F.col("user_id") % 11 == 0, None).otherwise(F.col("user_id")).alias("relation"),
        F.when(F.col("value") > 50, "ExclusiveLock").otherwise("ShareLock").alias("mode"),
        (F.col("event_type") == "purchase").alias("granted"),
    )


def lock_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.to_date("ts").alias("snapshot_ts"),
        F.col("event_id").alias("pid"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("usename"),
        F.repeat("props", 40).alias("query"),
    )


LOCKS_SQL = """locks as (select ts::date as snapshot_ts, event_id as pid,
    case when value > 300 then 'tuple' else 'relation' end as locktype,
    case when user_id % 7 = 0 then null else user_id % 3 end as database,
    case when user_id % 11 = 0 then null else user_id end as relation,
    case when value > 50 then 'ExclusiveLock' else 'ShareLock' end as mode,
    event_type = 'purchase' as granted from events where event_type in ('error', 'purchase')),
    people as (select event_id as pid, 'user_' || user_id as usename,
        substring(repeat(props, 40), 1, 200) as query from events)"""


@query(
    "FIL-05",
    f"with {LOCKS_SQL} select pid, locktype, mode from locks where not granted",
)
def waiting_locks(spark, folder):
    return d.waiting_locks(locks(spark, folder)).select("pid", "locktype", "mode")


@query(
    "JON-03",
    f"""with {LOCKS_SQL} select b.pid as blocked_pid, x.usename as blocked_user, x.query as blocked_query,
        h.pid as blocking_pid, y.usename as blocking_user, y.query as blocking_query, b.locktype,
        b.mode as blocked_mode
    from locks b join people x on x.pid = b.pid
    join locks h on h.snapshot_ts = b.snapshot_ts and h.locktype = b.locktype
        and h.database is not distinct from b.database and h.relation is not distinct from b.relation
        and h.pid <> b.pid and h.granted
    join people y on y.pid = h.pid where not b.granted""",
)
def lock_waits(spark, folder):
    waits = d.lock_waits(locks(spark, folder), lock_sessions(spark, folder))
    return waits.drop("snapshot_ts")


SUMMARY_SQL = f"""{LOCKS_SQL}, summary as (select snapshot_ts, locktype, granted, count(*) as locks
    from locks group by all)"""


@query(
    "AGG-08 SRT-04",
    f"with {SUMMARY_SQL} select snapshot_ts::varchar as snapshot, locktype, granted, locks from summary",
)
def lock_summary(spark, folder):
    ordered = d.order_lock_summary(d.lock_summary(locks(spark, folder)))
    return ordered.select(F.col("snapshot_ts").cast("string").alias("snapshot"), "locktype", "granted", "locks")


@query(
    "AGG-08",
    f"""with {SUMMARY_SQL} select snapshot_ts::varchar as snapshot,
        coalesce(sum(locks) filter (not granted), 0)::bigint as waiting_locks_total,
        coalesce(sum(locks) filter (granted), 0)::bigint as granted_locks_total,
        string_agg(locktype || ' ' || granted || ' ' || locks, ', ' order by locktype, granted) as by_type
        from summary group by 1""",
)
def lock_totals(spark, folder):
    shown = F.transform(
        "by_type",
        lambda x: F.concat_ws(" ", x["locktype"], x["granted"].cast("string"), x["locks"].cast("string")),
    )
    return d.lock_totals(locks(spark, folder)).select(
        F.col("snapshot_ts").cast("string").alias("snapshot"),
        "waiting_locks_total", "granted_locks_total",
        F.array_join(shown, ", ").alias("by_type"),
    )


# ---------------------------------------------------------- database health per day
def day_sessions(spark: SparkSession, folder: str) -> DataFrame:
    day = F.to_date("snapshot_ts")
    noon = (day.cast("timestamp_ntz") + F.expr("interval 12 hours"))
    return sessions(spark, folder).select(
        day.alias("day"), noon.alias("snapshot_ts"), "pid", "state", "query_start", "query"
    )


def pressure(spark: SparkSession, folder: str) -> DataFrame:
    rows = locks(spark, folder).withColumnRenamed("snapshot_ts", "day")
    return d.pressure_counts(day_sessions(spark, folder), rows, 36_000, ["day"])


PRESSURE_SQL = f"""{SESSIONS_SQL}, {LOCKS_SQL}, slow_ as (select snapshot_ts::date as day,
    count(*) filter (state = 'active' and (epoch_us(date_trunc('day', snapshot_ts) + interval 12 hours)
        - epoch_us(query_start)) / 1000000.0 > 36000) as slow_queries_over_threshold from sessions group by 1),
    waiting_ as (select snapshot_ts as day, count(*) filter (not granted) as waiting_locks from locks group by 1),
    pressure as (select day, coalesce(slow_queries_over_threshold, 0) as slow_queries_over_threshold,
        coalesce(waiting_locks, 0) as waiting_locks from slow_ full join waiting_ using (day))"""


@query(
    "AGG-06",
    f"with {PRESSURE_SQL} select day::varchar as day, slow_queries_over_threshold, waiting_locks from pressure",
)
def pressure_counts(spark, folder):
    rows = pressure(spark, folder)
    return rows.select(F.col("day").cast("string").alias("day"), "slow_queries_over_threshold", "waiting_locks")


ACTIVITY_SQL = f"""{PRESSURE_SQL}, activity as (select day, slow_queries_over_threshold, waiting_locks,
    used * 100.0::double / 400 as connections_percent from pressure
    join (select snapshot_ts::date as day, count(*) as used from sessions group by 1) using (day)),
    graded as (select *, case when connections_percent > 90 or waiting_locks > 5 or slow_queries_over_threshold > 5
        then 'CRITICAL' when connections_percent > 70 or waiting_locks > 0 or slow_queries_over_threshold > 0
        then 'WARNING' else 'HEALTHY' end as activity_health from activity)"""


def activity(spark: SparkSession, folder: str) -> DataFrame:
    used = d.session_totals(day_sessions(spark, folder), ["day"])
    share = d.saturation(used, F.lit(400), digits=None)
    return pressure(spark, folder).join(share, "day").withColumn("activity_health", d.activity_health())


@query(
    "HLT-03",
    f"with {ACTIVITY_SQL} select day::varchar as day, connections_percent, activity_health from graded",
)
def activity_health(spark, folder):
    return activity(spark, folder).select(
        F.col("day").cast("string").alias("day"), "connections_percent", "activity_health"
    )


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counters: views are buffer hits, clicks are reads, errors over 300 deadlocks."""
    events = table(spark, folder, "events")

    def count(condition):
        return F.count_if(condition).cast("bigint")

    kind = F.col("event_type")
    return events.groupBy(F.to_date("ts").alias("snapshot_ts"), F.col("user_id").alias("datname")).agg(
        count(kind == "view").alias("blks_hit"),
        count(kind == "click").alias("blks_read"),
        count((kind == "error") & (F.col("value") > 100)).alias("deadlocks"),
        count((kind == "signup") & (F.col("value") > 30)).alias("temp_files"),
    )


RUNTIME_SQL = f"""{LOCKS_SQL}, counters as (select ts::date as snapshot_ts, user_id as datname,
    count(*) filter (event_type = 'view') as blks_hit, count(*) filter (event_type = 'click') as blks_read,
    count(*) filter (event_type = 'error' and value > 100) as deadlocks,
    count(*) filter (event_type = 'signup' and value > 30) as temp_files from events group by 1, 2),
    ratios as (select *, case when blks_hit + blks_read > 0 then blks_hit * 100.0::double / (blks_hit + blks_read)
        end as buffer_hit_ratio_pct from counters),
    lock_totals as (select snapshot_ts, relation as datname, count(*) filter (not granted) as waiting_locks_total
        from locks where relation is not null group by 1, 2),
    runtime as (select r.*, waiting_locks_total, case when coalesce(waiting_locks_total, 0) > 0 or deadlocks > 0
            then 'CRITICAL' when temp_files > 0 or coalesce(buffer_hit_ratio_pct < 90, false) then 'WARNING'
            else 'HEALTHY' end as health
        from ratios r left join lock_totals using (snapshot_ts, datname))"""


def runtime(spark: SparkSession, folder: str) -> DataFrame:
    ratios = d.hit_ratio(counters(spark, folder), digits=None)
    waits = locks(spark, folder).where(F.col("relation").isNotNull())
    by_relation = d.lock_totals(waits, ["snapshot_ts", "relation"]).select(
        "snapshot_ts", F.col("relation").alias("datname"), "waiting_locks_total"
    )
    joined = ratios.join(by_relation, ["snapshot_ts", "datname"], "left")
    return joined.withColumn("slow_query_count", F.lit(0).cast("bigint")).withColumn(
        "health", d.runtime_health()
    )


@query(
    "AGG-09",
    f"with {RUNTIME_SQL} select snapshot_ts::varchar as day, datname, buffer_hit_ratio_pct from ratios",
)
def buffer_hit_ratio(spark, folder):
    return d.hit_ratio(counters(spark, folder), digits=None).select(
        F.col("snapshot_ts").cast("string").alias("day"), "datname", "buffer_hit_ratio_pct"
    )


@query(
    "HLT-04 HLT-05",
    f"""with {RUNTIME_SQL} select snapshot_ts::varchar as day, datname, health, concat_ws('; ',
        case when waiting_locks_total > 0 then waiting_locks_total || ' waiting lock(s) — possible contention' end,
        case when deadlocks > 0 then deadlocks || ' deadlock(s) recorded since stats reset' end,
        case when temp_files > 0 then temp_files || ' temp file(s) used — possible work_mem pressure' end,
        case when buffer_hit_ratio_pct < 90 then 'Buffer hit ratio low' end) as issues from runtime""",
)
def runtime_health(spark, folder):
    notes = F.transform(d.runtime_issues(), lambda x: F.regexp_replace(x, r" at .*shared_buffers$", ""))
    return runtime(spark, folder).select(
        F.col("snapshot_ts").cast("string").alias("day"), "datname", "health",
        F.array_join(notes, "; ").alias("issues"),
    )


# ------------------------------------------------------------------------------ host
def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is a memory sample of its user's host."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("host"),
        F.to_date("ts").alias("day"),
        F.col("event_id").alias("sample_no"),
        (F.col("value") / 5).alias("ram_used_percent"),
        F.col("event_type"),
    )


TREND_SQL = """samples as (select user_id as host, event_id as sample_no, value / 5 as ram_used_percent,
    event_type from events),
    frames as (select *, ram_used_percent - first_value(ram_used_percent) over w as delta, count(*) over w as n
        from samples window w as (partition by host order by sample_no rows between 9 preceding and current row)),
    trends as (select *, case when n < 2 then 'INSUFFICIENT_DATA' when delta > 5 then 'RISING'
        when delta < -5 then 'FALLING' else 'STABLE' end as trend,
        case when n < 2 then 0 else delta end as delta_percent from frames)"""


def trends(spark: SparkSession, folder: str) -> DataFrame:
    return host.trend(
        samples(spark, folder), ["host"], "day", [F.col("sample_no")], digits=None, block_rows=50_000
    )


@query(
    "WIN-06",
    f"with {TREND_SQL} select host, sample_no, trend, delta_percent from trends",
)
def memory_trend(spark, folder):
    return trends(spark, folder).select("host", "sample_no", "trend", "delta_percent")


@query(
    "WIN-06",
    """with frames as (select event_id as sample_no, event_type as host, value / 5 - first_value(value / 5) over w
        as delta, count(*) over w as n from events window w as
        (partition by event_type order by ts, event_id rows between 9 preceding and current row))
    select host, sample_no, case when n < 2 then 'INSUFFICIENT_DATA' when delta > 5 then 'RISING'
        when delta < -5 then 'FALLING' else 'STABLE' end as trend,
        case when n < 2 then 0 else delta end as delta_percent from frames""",
)
def trend_of_few_hosts(spark, folder):
    """Few hosts with very many samples each and no coarse time: blocks are cut at quantiles."""
    rows = table(spark, folder, "events").select(
        F.col("event_type").alias("host"), "ts", F.col("event_id").alias("sample_no"),
        (F.col("value") / 5).alias("ram_used_percent"),
    )
    order = [F.col("ts"), F.col("sample_no")]
    found = host.trend(rows, ["host"], None, order, digits=None, block_rows=1_000)
    return found.select("host", "sample_no", "trend", "delta_percent")


MEMORY_SQL = f"""{TREND_SQL}, memory as (select *, case when ram_used_percent > 90 or
        (event_type = 'click' and ram_used_percent > 40) or event_type = 'error' and ram_used_percent > 60 then 'CRITICAL'
    when ram_used_percent > 85 or (event_type = 'click' and ram_used_percent > 10) then 'WARNING'
    when trend = 'RISING' then 'MONITOR' else 'HEALTHY' end as memory_health,
    case when ram_used_percent * 1.5 > 90 or sample_no % 100 / 10.0 > 8 then 'CRITICAL'
         when ram_used_percent * 1.5 > 70 or sample_no % 100 / 10.0 > 4.8 then 'WARNING'
         else 'HEALTHY' end as cpu_health from trends)"""


def graded(spark: SparkSession, folder: str) -> DataFrame:
    ram = F.col("ram_used_percent")
    kind = F.col("event_type")
    swap = F.when(kind == "click", ram).otherwise(0.0)
    oom = (kind == "error") & (ram > 60)
    load = F.col("sample_no") % 100 / 10.0
    return trends(spark, folder).withColumns(
        {
            "memory_health": host.memory_health(ram, swap, oom, F.col("trend")),
            "cpu_health": host.cpu_health(ram * 1.5, load, F.lit(4), F.lit(None).cast("double")),
        }
    )


@query("HLT-02", f"with {MEMORY_SQL} select host, sample_no, memory_health from memory")
def memory_health(spark, folder):
    return graded(spark, folder).select("host", "sample_no", "memory_health")


@query("HLT-01", f"with {MEMORY_SQL} select host, sample_no, cpu_health from memory")
def cpu_health(spark, folder):
    return graded(spark, folder).select("host", "sample_no", "cpu_health")


OVERALL_SQL = f"""{MEMORY_SQL}, ranks as (select host, case 'CRITICAL' when memory_health then 3 when cpu_health then 3
    else case 'WARNING' when memory_health then 2 when cpu_health then 2
    else case 'MONITOR' when memory_health then 1 else 0 end end end as rank from memory),
    overall as (select host, ['HEALTHY', 'MONITOR', 'WARNING', 'CRITICAL'][max(rank) + 1] as overall_health
        from ranks group by 1)"""


def overall(spark: SparkSession, folder: str) -> DataFrame:
    rows = graded(spark, folder).withColumn(
        "grade", host.overall_health(F.col("memory_health"), F.col("cpu_health"), F.lit("UNKNOWN"))
    )
    return host.worst_health(rows, ["host"], "grade")


@query("AGG-14", f"with {OVERALL_SQL} select * from overall")
def overall_health(spark, folder):
    return overall(spark, folder)


# -------------------------------------------------------------------- evidence tables
@query(
    "HLT-01 HLT-02 HLT-03 WIN-06 AGG-14",
    f"""with {MEMORY_SQL}, {ACTIVITY_SQL}, rows_ as (select m.*, coalesce(activity_health, 'UNKNOWN') as postgres_health
        from memory m join events e on e.event_id = m.sample_no left join graded g on g.day = e.ts::date)
    select host, sample_no, trend, cpu_health, memory_health, postgres_health,
        case when 'CRITICAL' in (cpu_health, memory_health, postgres_health) then 'CRITICAL'
        when 'WARNING' in (cpu_health, memory_health, postgres_health) then 'WARNING'
        when memory_health = 'MONITOR' then 'MONITOR' else 'HEALTHY' end as overall_health from rows_""",
)
def host_evidence(spark, folder):
    ram, kind = F.col("ram_used_percent"), F.col("event_type")
    rows = samples(spark, folder).withColumns(
        {
            "cpu_percent": ram * 1.5,
            "load_avg": F.col("sample_no") % 100 / 10.0,
            "cores": F.lit(4),
            "iowait_percent": F.lit(None).cast("double"),
            "swap_percent": F.when(kind == "click", ram).otherwise(0.0),
            "oom": (kind == "error") & (ram > 60),
        }
    )
    found = evidence.host_evidence(
        rows, activity(spark, folder), "day", "day", [F.col("sample_no")], digits=None
    )
    return found.select(
        "host", "sample_no", "trend", "cpu_health", "memory_health", "postgres_health", "overall_health"
    )


@query(
    "AGG-05 AGG-07 AGG-08 AGG-09 AGG-16 JON-03 HLT-04 HLT-05",
    f"""with {SESSIONS_SQL}, {LOCKS_SQL}, s as (select *, xact_start::date as day from sessions),
    used as (select day, count(*) as total_connections,
        count(*) filter (state = 'idle in transaction') as idle_in_transaction,
        count(*) * 100.0::double / 400 as connections_percent,
        count(*) filter (state is not null and query <> '' and {_AGE} >= 1800) as slow_query_count
        from s group by 1),
    states as (select day, string_agg(state || ' ' || n, ', ' order by state) as sessions_by_state
        from (select day, coalesce(state, 'unknown') as state, count(*) as n from s group by 1, 2) group by 1),
    held as (select snapshot_ts as day, count(*) filter (not granted) as waiting_locks_total,
        count(*) filter (granted) as granted_locks_total from locks group by 1),
    waits as (select b.snapshot_ts as day, count(*) as lock_waits from locks b
        join locks h on h.snapshot_ts = b.snapshot_ts and h.locktype = b.locktype
            and h.database is not distinct from b.database and h.relation is not distinct from b.relation
            and h.pid <> b.pid and h.granted where not b.granted group by 1),
    counted as (select ts::date as day, count(*) filter (event_type = 'view') as blks_hit,
        count(*) filter (event_type = 'click') as blks_read,
        count(*) filter (event_type = 'error' and value > 490) as deadlocks,
        count(*) filter (event_type = 'signup' and value > 300) as temp_files from events group by 1),
    joined as (select *, case when blks_hit + blks_read > 0 then blks_hit * 100.0::double / (blks_hit + blks_read) end
        as ratio from counted left join used using (day) left join states using (day)
        left join held using (day) left join waits using (day))
    select day::varchar as day, coalesce(total_connections, 0) as total_connections,
        coalesce(idle_in_transaction, 0) as idle_in_transaction, connections_percent, sessions_by_state,
        coalesce(slow_query_count, 0) as slow_query_count, coalesce(waiting_locks_total, 0) as waiting_locks_total,
        coalesce(granted_locks_total, 0) as granted_locks_total, coalesce(lock_waits, 0) as lock_waits,
        ratio as buffer_hit_ratio_pct,
        case when coalesce(waiting_locks_total, 0) > 0 or deadlocks > 0 then 'CRITICAL'
            when coalesce(slow_query_count, 0) > 0 or temp_files > 0 or coalesce(ratio < 90, false) then 'WARNING'
            else 'HEALTHY' end as health,
        concat_ws('; ', case when slow_query_count > 0 then slow_query_count || ' slow/active query(s) >= 1800s' end,
            case when waiting_locks_total > 0 then waiting_locks_total || ' waiting lock(s) — possible contention' end,
            case when deadlocks > 0 then deadlocks || ' deadlock(s) recorded since stats reset' end,
            case when temp_files > 0 then temp_files || ' temp file(s) used — possible work_mem pressure' end,
            case when ratio < 90 then 'Buffer hit ratio low' end) as issues
    from joined""",
)
def database_evidence(spark, folder):
    """One row per day; its sessions, locks and counters are those of the events of the day."""
    daily = sessions(spark, folder).withColumn("day", F.to_date("xact_start"))
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    counted = events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(kind == "view").alias("blks_hit"),
        F.count_if(kind == "click").alias("blks_read"),
        F.count_if((kind == "error") & (F.col("value") > 490)).alias("deadlocks"),
        F.count_if((kind == "signup") & (F.col("value") > 300)).alias("temp_files"),
    )
    found = evidence.database_evidence(
        daily, locks(spark, folder).withColumnRenamed("snapshot_ts", "day"), counted,
        F.lit(400), ["day"], 1800, digits=None,
    )
    states = F.transform(
        "sessions_by_state", lambda x: F.concat_ws(" ", x["state"], x["sessions"].cast("string"))
    )
    notes = F.transform("issues", lambda x: F.regexp_replace(x, r" at .*shared_buffers$", ""))
    return found.select(
        F.col("day").cast("string").alias("day"), "total_connections", "idle_in_transaction",
        "connections_percent", F.array_join(states, ", ").alias("sessions_by_state"), "slow_query_count",
        "waiting_locks_total", "granted_locks_total", "lock_waits", "buffer_hit_ratio_pct", "health",
        F.array_join(notes, "; ").alias("issues"),
    )
