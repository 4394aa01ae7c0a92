"""Database snapshots: sessions, locks, counters, and their health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import rules
from faultline.functions.numeric import rounded
from faultline.functions.ordered import null_safe_join
from faultline.functions.text import any_of, filled

SNAPSHOT = ["snapshot_ts"]


def seconds_between(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / 1_000_000.0


# --------------------------------------------------------------------- sessions
def live_sessions(sessions: DataFrame, own_pid: Column | None = None) -> DataFrame:
    """Sessions that have a state and a query, the observer's own left out."""
    kept = sessions.where(
        F.col("state").isNotNull() & F.col("query").isNotNull() & (F.col("query") != "")
    )
    return kept.where(F.col("pid") != own_pid) if own_pid is not None else kept


def session_durations(sessions: DataFrame, digits: int = 2) -> DataFrame:
    """Query and transaction age at the snapshot, and the start of the query."""
    return sessions.withColumns(
        {
            "query_duration_sec": F.round(
                seconds_between(F.col("snapshot_ts"), F.col("query_start")), digits
            ),
            "txn_duration_sec": F.round(
                seconds_between(F.col("snapshot_ts"), F.col("xact_start")), digits
            ),
            "query_excerpt": F.substring("query", 1, rules.QUERY_EXCERPT_CHARS),
        }
    )


def flag_slow(sessions: DataFrame, seconds: float = rules.SLOW_QUERY_SECONDS) -> DataFrame:
    """Slow from the threshold on; a session without a start is not slow."""
    age = F.coalesce(F.col("query_duration_sec"), F.lit(0.0))
    return sessions.withColumn("is_slow", age >= seconds)


def slow_count(flagged: DataFrame, by: list[str] = SNAPSHOT) -> DataFrame:
    return flagged.groupBy(*by).agg(F.count_if("is_slow").alias("slow_query_count"))


def is_long_active(seconds: float = rules.LONG_ACTIVE_SECONDS) -> Column:
    age = seconds_between(F.col("snapshot_ts"), F.col("query_start"))
    return (F.col("state") == "active") & (age > seconds)


def long_active(sessions: DataFrame, seconds: float = rules.LONG_ACTIVE_SECONDS) -> DataFrame:
    """Active sessions that run for longer than the threshold."""
    return sessions.where(is_long_active(seconds))


def order_sessions(sessions: DataFrame) -> DataFrame:
    """Oldest query first, sessions without a start last; a range-partitioned sort."""
    return sessions.orderBy(F.col("query_start").asc_nulls_last(), "pid")


def sessions_by_state(sessions: DataFrame, by: list[str] = SNAPSHOT) -> DataFrame:
    state = F.coalesce(F.nullif(F.col("state"), F.lit("")), F.lit("unknown"))
    return sessions.groupBy(*by, state.alias("state")).agg(F.count(F.lit(1)).alias("sessions"))


def session_totals(sessions: DataFrame, by: list[str] = SNAPSHOT) -> DataFrame:
    return sessions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_connections"),
        F.count_if(F.col("state") == "idle in transaction").alias("idle_in_transaction"),
    )


def saturation(
    counts: DataFrame, max_connections: Column, digits: int | None = 2
) -> DataFrame:
    """Share of the allowed connections in use, null when none are allowed."""
    share = F.col("total_connections") * 100.0 / F.nullif(
        max_connections.cast("double"), F.lit(0.0)
    )
    return counts.withColumn("connections_percent", rounded(share, digits))


# ------------------------------------------------------------------------ locks
def waiting_locks(locks: DataFrame) -> DataFrame:
    return locks.where(~F.col("granted"))


def lock_waits(
    locks: DataFrame,
    sessions: DataFrame,
    by: list[str] = SNAPSHOT,
    slice_rows: int = 1000,
) -> DataFrame:
    """Who waits for whom: each waiting lock with the granted locks of other
    processes on the same object in the same snapshot.

    Null database and relation match null.  All equalities are join keys and only
    "another process" is left as a residual test, so this is a hash or merge join.
    The holders of an object are dealt by process into slices of about ``slice_rows``
    and its waiters, where there is anyone to wait for, are repeated per slice; so an
    object with very many locks is shared out over as many tasks as it needs, and a
    common one is not copied at all.  Sessions are joined by snapshot and process id,
    which is unique.
    """
    person = sessions.select(*by, "pid", "usename", "query")
    keys = [*by, "locktype", "database", "relation"]

    def with_session(rows: DataFrame, role: str) -> DataFrame:
        named = person.select(
            *[F.col(c).alias(f"__{c}") for c in (*by, "pid")],
            F.col("usename").alias(f"{role}_user"),
            F.substring("query", 1, rules.QUERY_EXCERPT_CHARS).alias(f"{role}_query"),
        )
        same = [rows[c].eqNullSafe(named[f"__{c}"]) for c in by]
        joined = rows.join(named, same + [rows[f"{role}_pid"] == named["__pid"]])
        return joined.drop(*[f"__{c}" for c in (*by, "pid")])

    held = locks.where(F.col("granted") & F.col("locktype").isNotNull()).select(
        *keys, F.col("pid").alias("blocking_pid")
    )
    slices = held.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("__slices")
    )
    waiting = waiting_locks(locks).select(
        *keys, F.col("pid").alias("blocked_pid"), F.col("mode").alias("blocked_mode")
    )
    blocked = with_session(null_safe_join(waiting, slices, keys, "inner"), "blocked").withColumn(
        "__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))
    ).drop("__slices")
    holders = with_session(null_safe_join(held, slices, keys, "inner"), "blocking").select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        "blocking_pid", "blocking_user", "blocking_query",
        F.pmod(F.xxhash64("blocking_pid"), F.col("__slices")).cast("int").alias("__deal"),
    )
    condition = (F.col("__slice") == F.col("__deal")) & (
        F.col("blocked_pid") != F.col("blocking_pid")
    )
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__{key}"))
    return blocked.join(holders, condition).select(
        *by,
        "blocked_pid", "blocked_user", "blocked_query",
        "blocking_pid", "blocking_user", "blocking_query",
        "locktype", "blocked_mode",
    )


def lock_summary(locks: DataFrame, by: list[str] = SNAPSHOT) -> DataFrame:
    return locks.groupBy(*by, "locktype", "granted").agg(F.count(F.lit(1)).alias("locks"))


def order_lock_summary(summary: DataFrame) -> DataFrame:
    """By lock type; snapshot and granted decide between equal types."""
    rest = [c for c in summary.columns if c not in ("locktype", "locks", "granted")]
    return summary.orderBy("locktype", *rest, "granted")


def lock_totals(locks: DataFrame, by: list[str] = SNAPSHOT) -> DataFrame:
    """Waiting and granted totals with the counts by type as an ordered list.

    The list has one entry per lock type and state, made from counted rows.
    """
    entry = F.struct("locktype", "granted", "locks")
    return (
        lock_summary(locks, by)
        .groupBy(*by)
        .agg(
            F.sum(F.when(~F.col("granted"), F.col("locks")).otherwise(0)).alias(
                "waiting_locks_total"
            ),
            F.sum(F.when(F.col("granted"), F.col("locks")).otherwise(0)).alias(
                "granted_locks_total"
            ),
            F.sort_array(F.collect_list(entry)).alias("by_type"),
        )
    )


def pressure_counts(
    sessions: DataFrame, locks: DataFrame, seconds: float = rules.LONG_ACTIVE_SECONDS,
    by: list[str] = SNAPSHOT,
) -> DataFrame:
    """Long-running sessions and waiting locks per snapshot, in one grouping."""
    zero = F.lit(0)
    slow = sessions.select(*by, is_long_active(seconds).cast("int").alias("s"), zero.alias("w"))
    waiting = locks.select(*by, zero.alias("s"), (~F.col("granted")).cast("int").alias("w"))
    return (
        slow.unionByName(waiting)
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum("s"), zero).alias("slow_queries_over_threshold"),
            F.coalesce(F.sum("w"), zero).alias("waiting_locks"),
        )
    )


# --------------------------------------------------------------------- counters
def hit_ratio(counters: DataFrame, digits: int | None = 2) -> DataFrame:
    """Share of block reads served from the buffer, null when nothing was read."""
    hit = F.coalesce(F.col("blks_hit"), F.lit(0))
    total = (hit + F.coalesce(F.col("blks_read"), F.lit(0))).cast("double")
    share = hit * 100.0 / F.nullif(total, F.lit(0.0))
    return counters.withColumn(
        "buffer_hit_ratio_pct", rounded(F.when(total > 0, share), digits)
    )


# ----------------------------------------------------------------------- health
def activity_health(status: Column | None = None) -> Column:
    """Health of the database activity; anything but SUCCESS is UNKNOWN."""
    values = {
        "connections": F.coalesce(F.col("connections_percent"), F.lit(0.0)),
        "locks": F.col("waiting_locks"),
        "slow": F.col("slow_queries_over_threshold"),
    }

    def over(limits: dict) -> Column:
        return any_of([values[name] > limit for name, limit in limits.items()])

    graded = (
        F.when(over(rules.ACTIVITY_CRITICAL), "CRITICAL")
        .when(over(rules.ACTIVITY_WARNING), "WARNING")
        .otherwise("HEALTHY")
    )
    if status is None:
        return graded
    return F.when(status.eqNullSafe("SUCCESS"), graded).otherwise("UNKNOWN")


def _runtime_parts() -> dict[str, Column]:
    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    hit = F.col("buffer_hit_ratio_pct")
    return {
        "slow": count("slow_query_count"),
        "locks": count("waiting_locks_total"),
        "deadlocks": count("deadlocks"),
        "temp": count("temp_files"),
        "hit": hit,
        "low_hit": F.coalesce(hit < rules.BUFFER_HIT_LOW, F.lit(False)),
    }


def runtime_health() -> Column:
    part = _runtime_parts()
    return (
        F.when((part["locks"] > 0) | (part["deadlocks"] > 0), "CRITICAL")
        .when((part["slow"] > 0) | (part["temp"] > 0) | part["low_hit"], "WARNING")
        .otherwise("HEALTHY")
    )


def runtime_issues(seconds: int = rules.SLOW_QUERY_SECONDS) -> Column:
    """The issues found, as texts in a fixed order."""
    part = _runtime_parts()

    def note(condition: Column, sentence: str, number: Column) -> Column:
        return F.when(condition, filled(sentence, n=number, seconds=F.lit(seconds)))

    notes = [
        note(part["slow"] > 0, rules.ISSUE_SLOW, part["slow"]),
        note(part["locks"] > 0, rules.ISSUE_LOCKS, part["locks"]),
        note(part["deadlocks"] > 0, rules.ISSUE_DEADLOCKS, part["deadlocks"]),
        note(part["temp"] > 0, rules.ISSUE_TEMP_FILES, part["temp"]),
        note(part["low_hit"], rules.ISSUE_BUFFER_HIT, part["hit"]),
    ]
    return F.filter(F.array(*notes), lambda x: x.isNotNull())
