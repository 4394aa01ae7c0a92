"""Monitors keep the keys of a bucket in one state: many keys, null among them, few entries."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import host, loads
from faultline.streaming.in_order import stream_sla_in_order, stream_trend_in_order
from faultline.streaming.sla import stream_sla, stream_trend
from tests.test_streams import ONCE, in_parts

PROGRESS = "run_id long, chunk_no int, chunk_rows long, elapsed_seconds double, total_rows long, sla_threshold long"
SAMPLES = "host long, day int, sample_no int, ram_used_percent double"
BIG = 2**60  # such a key is no float


def states(stream, folder):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/check").trigger(**ONCE).start()
    assert query.awaitTermination(120)
    seen = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out"), max(seen), seen[-1]


def same(got, want):
    assert got.count() and sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


@pytest.mark.parametrize("monitor", [stream_sla, stream_sla_in_order])
def test_breaches_of_many_keys(spark, frame, tmp_path, monitor):
    keys = [None, *(BIG + i for i in range(39))]
    rows = [(k, c, 10 + (i + c) % 3, c * (1.0 + i % 5), 600, 9) for i, k in enumerate(keys) for c in range(8)]
    df = frame(rows, PROGRESS).withColumn("at", F.timestamp_seconds(F.col("chunk_no") + 10**9))
    done = loads.progress(df.withColumn("b", F.col("chunk_no")), ["run_id"], "b", [F.col("chunk_no")], digits=None)
    want = loads.first_breach(done, ["run_id"], [F.col("chunk_no")], digits=None)
    end = frame([(BIG - 1, 99, 0, 0.0, 0, 1)], PROGRESS).withColumn("at", F.timestamp_seconds(F.lit(2 * 10**9)))
    stream = in_parts(spark, df.unionByName(end), str(tmp_path / "in"), 3, "chunk_no")
    got, most, last = states(monitor(stream, "at", delay="1 hour", buckets=4), str(tmp_path))
    same(got, want)
    # entries: a state per bucket; in order also its waiting rows, of up to three micro-batches
    assert most <= (4 if monitor is stream_sla else 16)
    assert last <= 2  # all keys but the last one have expired


@pytest.mark.parametrize("monitor", [stream_trend, stream_trend_in_order])
def test_trends_of_many_keys(spark, frame, tmp_path, monitor):
    keys = [None, *(BIG + i for i in range(39))]
    rows = [(k, s // 4, s, float((s * 7 + i) % 23)) for i, k in enumerate(keys) for s in range(20)]
    df = frame(rows, SAMPLES).withColumn("at", F.timestamp_seconds(F.col("sample_no") + 10**9))
    want = host.trend(df, ["host"], "day", [F.col("sample_no")], digits=None)
    end = frame([(BIG - 1, 0, 99, 0.0)], SAMPLES).withColumn("at", F.timestamp_seconds(F.lit(2 * 10**9)))
    stream = in_parts(spark, df.unionByName(end), str(tmp_path / "in"), 3, "sample_no")
    got, most, _ = states(monitor(stream, "at", delay="1 hour", buckets=4), str(tmp_path))
    same(got.where(f"host is null or host <> {BIG - 1}"), want)
    assert most <= (4 if monitor is stream_trend else 16)
