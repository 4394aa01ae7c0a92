"""What the monitors share: the keys of a stream by bucket, and the steps over the rows of one.

A call of Python and an entry of state per key cost far more than the few rows of a key. So keys are
dealt into ``BUCKETS`` groups by their hash; a group holds the state of its keys as one small table
and works off the rows of all of them with array operations. A restarted stream needs the number of
buckets it began with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
BUCKET, KEY, TIME, LAST = "in_bucket", "of_key", "event_ms", "last_ms"

BREACH = (
    "total_rows long, rows_inserted long, pct_complete double, elapsed_seconds double, "
    "rows_per_second double, eta_seconds double, sla_threshold long, sla_breached_at double"
)


def dealt(rows: DataFrame, key: str, columns: list[str], buckets: int) -> DataFrame:
    """``rows`` with the bucket and the text of their key, which is exact for every type but nested
    ones; as text, a null among the keys of a batch leaves the others as they are."""
    kind = dict(rows.dtypes)[key]
    text = F.base64(key) if kind == "binary" else F.col(key).cast("string")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    return rows.withColumn(BUCKET, bucket).withColumn(KEY, text).select(BUCKET, KEY, *columns)


def keyed(found: DataFrame, key: str, kind: str) -> DataFrame:
    """What a monitor found, its first column the key in its own type."""
    value = F.unbase64(KEY) if kind == "binary" else F.col(KEY).cast(kind)
    return found.select(value.alias(key), *[c for c in found.columns if c != KEY])


def packed(frame) -> bytes:
    import pyarrow as pa

    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all().to_pandas()


def check_times(rows) -> None:
    """A key whose rows all lack an event time would wait for ever."""
    if rows[TIME].isna().any() and rows.groupby(KEY, dropna=False)[TIME].count().eq(0).any():
        raise ValueError("a key has rows without an event time only")


def worked(step, rows, kept, order: list[str], least: int | None = None):
    """``step`` over the rows of several keys: (result, state of all keys afterwards).

    ``kept`` is the state before, or None. ``step(rows, numbers, kept, kept_numbers, count)`` sees
    rows by key and order, with the numbers of their keys from 0, and returns (result, state, numbers
    of its keys). The state gets the time of the last row of its key, ``least`` at least.
    """
    import numpy as np
    import pandas as pd

    before = [] if kept is None else [kept[KEY]]
    numbers, keys = pd.factorize(pd.concat([*before, rows[KEY]]), use_na_sentinel=False)
    olds, news = np.split(numbers, [0 if kept is None else len(kept)])
    rows = rows.assign(number=news).sort_values(["number", *order], kind="stable")
    result, state, of = step(rows, rows["number"].to_numpy(), kept, olds, len(keys))
    last = np.full(len(keys), np.iinfo("int64").min)
    if kept is not None:
        last[olds] = kept[LAST]
    newest = rows.groupby("number")[TIME].max()
    last[newest.index] = newest.astype("int64") if least is None else newest.clip(lower=least).astype("int64")
    state = state.assign(**{KEY: keys.take(of), LAST: last[of]})
    return result, state


def _starts(numbers):
    """Place of the first row of each run of equal numbers, for every row."""
    import numpy as np

    first = np.r_[True, numbers[1:] != numbers[:-1]]
    return np.flatnonzero(first)[np.cumsum(first) - 1]


def sla_step(chunks, numbers, kept, olds, count):
    """The first chunk of each key that starts after its SLA; the state is rows loaded and whether
    the key was reported."""
    import numpy as np
    import pandas as pd

    inserted, reported = np.zeros(count, "int64"), np.zeros(count, bool)
    if kept is not None:
        inserted[olds], reported[olds] = kept["rows_inserted"], kept["reported"]
    loaded = chunks["chunk_rows"].fillna(0).to_numpy("int64")
    before = np.cumsum(loaded) - loaded
    before = before - before[_starts(numbers)] + inserted[numbers]
    late = (chunks["elapsed_seconds"] > chunks["sla_threshold"]).to_numpy() & ~reported[numbers]
    places = np.flatnonzero(late)
    places = places[np.unique(numbers[places], return_index=True)[1]]
    found, done = chunks.iloc[places], before[places]
    found["chunk_rows"].astype("int64")  # fails at a breach in a chunk of unknown size, as below
    total, threshold = found["total_rows"].astype("int64").to_numpy(), found["sla_threshold"].astype("int64").to_numpy()
    elapsed = found["elapsed_seconds"].to_numpy("float64")
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(total != 0, 100.0 * done / total, 0.0)
        speed = np.where(elapsed > 0, done / elapsed, 0.0)
        eta = np.where(speed > 0, (total - done) / speed, 0.0)
    result = pd.DataFrame(
        {
            KEY: found[KEY].to_numpy(), "total_rows": total, "rows_inserted": done, "pct_complete": share,
            "elapsed_seconds": elapsed, "rows_per_second": speed, "eta_seconds": eta,
            "sla_threshold": threshold, "sla_breached_at": elapsed,
        }
    )
    np.add.at(inserted, numbers, loaded)
    reported[numbers[places]] = True
    return result, pd.DataFrame({"rows_inserted": inserted, "reported": reported}), np.arange(count)


def trend_step(order: str, value: str, n: int, band: float):
    """The trend at each sample; the state is the last ``n - 1`` values of each key, a row each."""

    def step(rows, numbers, kept, olds, count):
        import numpy as np
        import pandas as pd

        old = np.empty(0) if kept is None else kept["recent"].to_numpy("float64")
        series = np.concatenate([old, rows[value].to_numpy("float64")])
        of = np.concatenate([olds, numbers])
        by = np.argsort(of, kind="stable")  # kept values come before the new ones
        series, of, new = series[by], of[by], by >= len(old)
        start, place = _starts(of), np.arange(len(of))
        delta = series - series[np.maximum(place - (n - 1), start)]
        names = np.select([delta > band, delta < -band], ["RISING", "FALLING"], "STABLE")
        enough = place > start
        result = pd.DataFrame(
            {
                KEY: rows[KEY].to_numpy(),
                order: rows[order].to_numpy(),
                "trend": np.where(enough, names, "INSUFFICIENT_DATA")[new],
                "delta_percent": np.where(enough, delta, 0.0)[new],
            }
        )
        after = np.bincount(of)[of] - (place - start)  # rows of the key from here on
        stays = after <= max(n - 1, 1)
        return result, pd.DataFrame({"recent": series[stays]}), of[stays]

    return step
