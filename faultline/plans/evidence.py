"""Evidence tables of hosts, databases and past incidents, each from raw rows to one row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import rules
from faultline.functions.ordered import null_safe_join
from faultline.operators import benchmarks as b
from faultline.operators import database as d
from faultline.operators import host
from faultline.plans.retrieve import retrieve
from faultline.sources.tables import in_dataset


def host_evidence(
    samples: DataFrame, activity: DataFrame, at: str, block: str, order: list[Column], digits: int | None = 2
) -> DataFrame:
    """Per host sample: trend, health of processor, memory and database, and the worst of the three.

    ``samples`` holds ``host, cpu_percent, load_avg, cores, iowait_percent, ram_used_percent,
    swap_percent, oom``, ``at`` and ``block`` (a coarse time, which may be ``at``).  ``activity``
    holds ``activity_health`` once per ``at``; without one it is UNKNOWN and weighs nothing.
    """
    traced = host.trend(samples, ["host"], block, order, digits=digits)
    graded = traced.withColumns(
        {
            "cpu_health": host.cpu_health(
                F.col("cpu_percent"), F.col("load_avg"), F.col("cores"), F.col("iowait_percent")
            ),
            "memory_health": host.memory_health(
                F.col("ram_used_percent"), F.col("swap_percent"), F.col("oom"), F.col("trend")
            ),
        }
    )
    known = activity.select(at, F.col("activity_health").alias("postgres_health"))
    return null_safe_join(graded, known, [at]).withColumns(
        {
            "postgres_health": F.coalesce("postgres_health", F.lit("UNKNOWN")),
            "overall_health": host.overall_health(
                F.col("cpu_health"), F.col("memory_health"), F.col("postgres_health")
            ),
        }
    )


def database_evidence(
    sessions: DataFrame,
    locks: DataFrame,
    counters: DataFrame,
    max_connections: Column,
    by: list[str] = d.SNAPSHOT,
    slow_seconds: int = rules.SLOW_QUERY_SECONDS,
    digits: int | None = 2,
) -> DataFrame:
    """Per snapshot: connections, states, slow queries, locks, lock waits, counters, health, issues.

    A snapshot that any of the three tables holds has a row; what the others lack counts as 0.
    Each part is an aggregate of its own, so the joins meet one row per snapshot.
    """
    flagged = d.flag_slow(d.session_durations(d.live_sessions(sessions), digits=6), slow_seconds)
    states = d.sessions_by_state(sessions, by).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("state", "sessions"))).alias("sessions_by_state")
    )
    waits = d.lock_waits(locks, sessions, by).groupBy(*by).agg(F.count(F.lit(1)).alias("lock_waits"))
    parts = [
        d.saturation(d.session_totals(sessions, by), max_connections, digits),
        states,
        d.slow_count(flagged, by),
        d.lock_totals(locks, by),
        waits,
        d.hit_ratio(counters, digits),
    ]
    keys = reduce(DataFrame.unionByName, [p.select(*by) for p in (parts[0], parts[3], parts[5])]).distinct()
    joined = reduce(lambda rows, part: null_safe_join(rows, part, by), parts, keys)
    numbers = [
        "total_connections", "idle_in_transaction", "slow_query_count",
        "waiting_locks_total", "granted_locks_total", "lock_waits",
    ]
    filled = joined.withColumns({n: F.coalesce(F.col(n), F.lit(0).cast("bigint")) for n in numbers})
    return filled.withColumns({"health": d.runtime_health(), "issues": d.runtime_issues(slow_seconds)})


def history_evidence(
    queries: DataFrame,
    chunks: DataFrame,
    cases: DataFrame,
    source_dataset: str | None = None,
    k: int = rules.EVIDENCE_TOP_K,
    multiplier: int = rules.CANDIDATE_MULTIPLIER,
    metric: str = "l2",
    digits: int | None = 1,
) -> DataFrame:
    """Per query: how many past incidents were found, the closest one, and their benchmarks.

    ``queries`` holds ``query_id, embedding, current_volume``.  With ``source_dataset`` only the
    chunks of that dataset are searched.  A query without a find keeps its row.
    """
    searched = chunks if source_dataset is None else in_dataset(chunks, source_dataset)
    found = b.to_incident(retrieve(queries, searched, cases, k, multiplier, metric))
    by = ["query_id"]
    closest = found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("incidents_found"),
        F.min_by("incident_id", "case_rank").alias("top_match_id"),
        F.max("similarity_score").alias("top_similarity"),
    )
    near = b.volume_band(
        found, queries.select(*by, "current_volume"), by[0], F.xxhash64("incident_id")
    )
    marks = b.full_benchmarks(near, by, F.col("case_rank"), digits)
    rows = queries.select(*by).join(closest, by, "left").join(marks, by, "left")
    return rows.withColumns(
        {
            "incidents_found": F.coalesce("incidents_found", F.lit(0).cast("bigint")),
            "has_benchmarks": F.coalesce(F.col("benchmark_incident_count") > 0, F.lit(False)),
        }
    )
