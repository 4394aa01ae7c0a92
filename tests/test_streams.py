import datetime as dt

from pyspark.sql import functions as F

from faultline.operators import host, loads, sinks
from faultline.streaming.load import loaded, stream_load
from faultline.streaming.sla import stream_sla, stream_trend, stream_triggers

ONCE = {"availableNow": True}


def run(stream, folder):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/check").trigger(**ONCE).start()
    assert query.awaitTermination(90)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def in_parts(spark, df, folder, parts, order):
    """Writes a frame as files that a stream reads one after the other."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_sla_monitor_equals_batch(spark, frame, tmp_path):
    rows = [("hot", i, 10, i * 1.5, 600, 30) for i in range(60)] + [("ok", 0, 10, 1.0, 10, 30), ("late", 1, 5, 31.0, 10, 30)]
    df = frame(rows, "run_id string, chunk_no int, chunk_rows long, elapsed_seconds double, total_rows long, sla_threshold long")
    df = df.withColumn("at", F.timestamp_seconds(F.col("chunk_no") + 10**9))
    got = run(stream_sla(in_parts(spark, df, str(tmp_path / "in"), 4, "chunk_no"), "at"), str(tmp_path))
    done = loads.progress(df.withColumn("b", F.floor(F.col("chunk_no") / 7)), ["run_id"], "b", [F.col("chunk_no")], digits=None)
    want = loads.first_breach(done, ["run_id"], [F.col("chunk_no")], digits=None)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_sla_monitor_with_watermark(spark, frame, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [("r", i, 10, i * 20.0, 100, 30, start + dt.timedelta(minutes=i)) for i in range(6)]
    df = frame(rows, "run_id string, chunk_no int, chunk_rows long, elapsed_seconds double, total_rows long, "
                     "sla_threshold long, at timestamp")
    stream = stream_sla(in_parts(spark, df, str(tmp_path / "in"), 3, "chunk_no"), "at", delay="10 minutes")
    assert [(r.rows_inserted, r.sla_breached_at) for r in run(stream, str(tmp_path)).collect()] == [(20, 40.0)]


def test_trend_equals_batch(spark, frame, tmp_path):
    df = frame([("h", i // 9, i, float((i * 7) % 23)) for i in range(50)], "host string, day int, sample_no int, ram_used_percent double")
    df = df.withColumn("at", F.timestamp_seconds(F.col("sample_no") + 10**9))
    got = run(stream_trend(in_parts(spark, df, str(tmp_path / "in"), 3, "sample_no"), "at"), str(tmp_path))
    want = host.trend(df, ["host"], "day", [F.col("sample_no")], digits=None)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_triggers_once_per_run(spark, frame, tmp_path):
    start = dt.datetime(2026, 1, 1)
    df = frame([(f"r{i % 3}", start + dt.timedelta(seconds=i)) for i in range(12)], "run string, at timestamp_ntz")
    stream = stream_triggers(in_parts(spark, df, str(tmp_path / "in"), 3, "at"), ["run"], "at")
    assert sorted(r.run for r in run(stream, str(tmp_path)).collect()) == ["r0", "r1", "r2"]


def test_incremental_load_equals_batch(spark, frame, tmp_path):
    df = frame([(i % 7 if i % 9 else None, f"v{i}", i) for i in range(40)], "k int, v string, pos int")
    stream = in_parts(spark, df, str(tmp_path / "in"), 4, "pos")
    target = str(tmp_path / "t")
    query = stream_load(stream, target, str(tmp_path / "check"), "k", "pos", ONCE)
    assert query.awaitTermination(90)
    want = sinks.first_per_key(df.where("k is not null"), "k", [F.col("pos")])
    got = loaded(spark, target, df.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    again = stream_load(stream, target, str(tmp_path / "check"), "k", "pos", ONCE)
    assert again.awaitTermination(90)
    assert loaded(spark, target, df.schema).count() == 7
