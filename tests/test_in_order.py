"""Monitors by event time: rows dealt over micro-batches at random give the batch result."""

import random

from pyspark.sql import functions as F

from faultline.operators import host, loads
from faultline.streaming.in_order import stream_sla_in_order, stream_trend_in_order
from tests.test_streams import run

CHUNKS = "run_id string, chunk_no int, chunk_rows long, elapsed_seconds double, total_rows long, sla_threshold long, at timestamp"


def shuffled(spark, df, folder, parts, last, seed=1):
    """Files that a stream reads one after the other, each with rows of all times; the last row,
    of another key and far ahead, lets the watermark pass them all."""
    rows = df.collect()
    random.Random(seed).shuffle(rows)
    for i in range(parts):
        part = rows[i::parts] + ([last] if i == parts - 1 else [])
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_sla_by_event_time(spark, frame, tmp_path):
    rows = [(r, i, 10 + i, i * 1.5, 600, 30) for r in ("hot", "cold") for i in range(60)] + [("ok", 0, 10, 1.0, 10, 30)]
    df = frame([(*r, None) for r in rows], CHUNKS).withColumn("at", F.timestamp_seconds(F.col("chunk_no") + 10**9))
    last = ("end", 0, 0, 0.0, 0, 1, None)
    last = frame([last], CHUNKS).withColumn("at", F.timestamp_seconds(F.lit(10**9 + 10**6))).first()
    stream = stream_sla_in_order(shuffled(spark, df, str(tmp_path / "in"), 5, last), "at")
    got = run(stream, str(tmp_path))
    done = loads.progress(df.withColumn("b", F.floor(F.col("chunk_no") / 7)), ["run_id"], "b", [F.col("chunk_no")], digits=None)
    want = loads.first_breach(done, ["run_id"], [F.col("chunk_no")], digits=None)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_trend_by_event_time_and_state_expires(spark, frame, tmp_path):
    df = frame([(h, i // 9, i, float((i * 7 + len(h)) % 23)) for h in ("h", "hh") for i in range(50)],
               "host string, day int, sample_no int, ram_used_percent double")
    df = df.withColumn("at", F.timestamp_seconds(F.col("sample_no") + 10**9))
    last = frame([("end", 0, 999, 0.0)], "host string, day int, sample_no int, ram_used_percent double").withColumn(
        "at", F.timestamp_seconds(F.lit(10**9 + 10**6))).first()
    stream = stream_trend_in_order(shuffled(spark, df, str(tmp_path / "in"), 4, last), "at")
    got = run(stream, str(tmp_path))
    want = host.trend(df, ["host"], "day", [F.col("sample_no")], digits=None)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
