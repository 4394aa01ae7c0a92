"""Streaming monitors that work by event time, whatever order the rows arrive in.

Rows wait in the state of the bucket of their key until the watermark has passed them, and are then worked off in
order of event time.  So a chunk that arrives some micro-batches late, but before the watermark,
counts where it belongs, and the result is that of the batch operator.  A row is reported once the
watermark is past it, ``delay`` behind the newest event.  Rows behind the watermark are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import rules
from faultline.streaming.buckets import (
    BREACH, BUCKET, BUCKETS, KEY, LAST, TIME, check_times, dealt, keyed, packed, sla_step, trend_step, unpacked, worked,
)
from faultline.streaming.sla import DAY_MS

#: State with timers needs the store that keeps it on disk.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _worked_in_order(
    rows: DataFrame, event_time: str, key: str, order: str, columns: list[str], delay: str, idle_ms: int,
    output: str, step, buckets: int,
) -> DataFrame:
    """``step`` sees the rows of a bucket in order, with the state of its keys.

    A bucket waits with a timer for its earliest row; when it is due, all rows up to the watermark
    are worked off.  The state of a key without waiting rows is dropped ``idle_ms`` after its last one.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    names = [KEY, TIME, order, *columns]
    timed = (
        rows.withColumn(event_time, F.col(event_time).cast("timestamp"))
        .withColumn(TIME, F.unix_millis(event_time))
        .withWatermark(event_time, delay)
    )
    timed = dealt(timed, key, [event_time, *names[1:]], buckets)

    class InOrder(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getListState("waiting", "rows binary")
            self.kept = handle.getValueState("kept", "rows binary")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            arrived = pd.concat(list(rows))[names]
            check_times(arrived)
            self.waiting.appendValue((packed(arrived),))
            self.handle.registerTimer(int(arrived[TIME].min()))
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            water = timerValues.getCurrentWatermarkInMs()
            parts = [unpacked(bytes(r[0])) for r in self.waiting.get()]
            waiting = pd.concat(parts) if parts else pd.DataFrame(columns=names)
            due, rest = waiting[waiting[TIME] <= water], waiting[waiting[TIME] > water]
            kept = unpacked(bytes(self.kept.get()[0])) if self.kept.exists() else None
            result = None
            if len(due):
                result, kept = worked(step, due, kept, [TIME, order])
                if len(rest):
                    self.waiting.put([(packed(rest),)])
                else:
                    self.waiting.clear()
            wakes = [int(rest[TIME].min())] if len(rest) else []
            if kept is not None:
                busy = kept[KEY].isin(waiting[KEY])
                stays = kept[(kept[LAST] + idle_ms > water) | busy]
                # keys with waiting rows are looked at again when those are due
                idle = stays[~stays[KEY].isin(rest[KEY])]
                if len(idle):
                    wakes.append(max(int(idle[LAST].min()) + idle_ms, water + 1))
                if len(stays) == 0:
                    self.kept.clear()
                elif len(due) or len(stays) < len(kept):
                    self.kept.update((packed(stays),))
            if wakes:
                self.handle.registerTimer(min(wakes))
            if result is not None and len(result):
                yield result

        def close(self):
            pass

    found = timed.groupBy(BUCKET).transformWithStateInPandas(
        InOrder(), f"{KEY} string, {output}", "Append", "EventTime"
    )
    return keyed(found, key, dict(rows.dtypes)[key])


def stream_sla_in_order(
    progress: DataFrame, event_time: str, key: str = "run_id", delay: str = "1 hour", idle_ms: int = DAY_MS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per run, at the first chunk, by event time, that starts after the SLA has passed.

    ``progress`` has ``chunk_no, chunk_rows, elapsed_seconds, total_rows, sla_threshold``; chunks of
    one time follow by ``chunk_no``.
    """
    columns = ["chunk_rows", "elapsed_seconds", "total_rows", "sla_threshold"]
    return _worked_in_order(
        progress, event_time, key, "chunk_no", columns, delay, idle_ms, BREACH, sla_step, buckets
    )


def stream_trend_in_order(
    samples: DataFrame, event_time: str, key: str = "host", order: str = "sample_no",
    value: str = "ram_used_percent", n: int = rules.TREND_SAMPLES, band: float = rules.TREND_BAND,
    delay: str = "1 hour", idle_ms: int = DAY_MS, buckets: int = BUCKETS,
) -> DataFrame:
    """Memory trend at each sample, against the samples before it by event time; samples of one
    time follow by ``order``."""
    output = f"{order} {dict(samples.dtypes)[order]}, trend string, delta_percent double"
    step = trend_step(order, value, n, band)
    return _worked_in_order(samples, event_time, key, order, [value], delay, idle_ms, output, step, buckets)
