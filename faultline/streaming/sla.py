"""Streaming monitors: SLA breaches, memory trend, repeat triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from faultline import rules
from faultline.streaming.buckets import (
    BREACH, BUCKET, BUCKETS, KEY, LAST, TIME, check_times, dealt, keyed, packed, sla_step, trend_step, unpacked, worked,
)

DAY_MS = 86_400_000


def _timed(rows: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Watermark, and the event time in milliseconds."""
    timed = rows.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withColumn(TIME, F.unix_millis(event_time)).withWatermark(event_time, delay)


def _watched(
    rows: DataFrame, event_time: str, key: str, order: str, columns: list[str], delay: str, idle_ms: int,
    output: str, step, buckets: int,
) -> DataFrame:
    """``step`` over the rows of each bucket and micro-batch, with the state of its keys, each
    dropped ``idle_ms`` after its last row has passed the watermark."""
    timed = dealt(_timed(rows, event_time, delay), key, [event_time, TIME, order, *columns], buckets)

    def watch(group, batches, state):
        import pandas as pd

        water = state.getCurrentWatermarkMs()
        kept = unpacked(state.get[0]) if state.exists else None
        result = None
        if state.hasTimedOut:
            arrived = pd.Series(dtype=object)
        else:
            arrived = pd.concat(list(batches))
            check_times(arrived)
            result, kept = worked(step, arrived, kept, [order], water)
            arrived = arrived[KEY]
        kept = kept[(kept[LAST] + idle_ms >= water) | kept[KEY].isin(arrived)]
        if len(kept):
            state.update((packed(kept),))
            state.setTimeoutTimestamp(int(kept[LAST].min()) + idle_ms)
        else:
            state.remove()
        if result is not None and len(result):
            yield result

    found = timed.groupBy(BUCKET).applyInPandasWithState(
        watch, f"{KEY} string, {output}", "kept binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    return keyed(found, key, dict(rows.dtypes)[key])


def stream_sla(
    progress: DataFrame,
    event_time: str,
    key: str = "run_id",
    delay: str = "1 hour",
    idle_ms: int = DAY_MS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per run, at the first chunk that starts after the SLA has passed.

    ``progress`` has ``chunk_no, chunk_rows, elapsed_seconds, total_rows,
    sla_threshold``, in chunk order within a run.  The state of a run is the rows
    loaded and whether it has been reported; it is dropped once the watermark, ``delay``
    behind the newest ``event_time``, is ``idle_ms`` past the last chunk of the run.  Rows
    behind the watermark are late and left out.  What a bucket of keys holds at once is its part
    of one micro-batch, which ``maxFilesPerTrigger`` of the source bounds.
    """
    columns = ["chunk_rows", "elapsed_seconds", "total_rows", "sla_threshold"]
    return _watched(
        progress, event_time, key, "chunk_no", columns, delay, idle_ms, BREACH, sla_step, buckets
    )


def stream_trend(
    samples: DataFrame,
    event_time: str,
    key: str = "host",
    order: str = "sample_no",
    value: str = "ram_used_percent",
    n: int = rules.TREND_SAMPLES,
    band: float = rules.TREND_BAND,
    delay: str = "1 hour",
    idle_ms: int = DAY_MS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Memory trend at each sample; the state of a host is its last ``n - 1`` values, and is
    dropped like that of :func:`stream_sla`."""
    output = f"{order} {dict(samples.dtypes)[order]}, trend string, delta_percent double"
    step = trend_step(order, value, n, band)
    return _watched(samples, event_time, key, order, [value], delay, idle_ms, output, step, buckets)


def stream_triggers(
    events: DataFrame, key: list[str], event_time: str, ttl: str = "1 hour"
) -> DataFrame:
    """The first trigger of each run; repeats within the time to live are dropped.

    ``event_time`` is cast, as a watermark needs a timestamp with a time zone.
    """
    timed = events.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, ttl).dropDuplicatesWithinWatermark(key)
