"""Streaming forms, run to the end of the shared tables and compared with batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import health, loads, logs
from bindings.common import Registry, fresh_folder, table
from faultline import rules
from faultline.streaming.in_order import stream_sla_in_order, stream_trend_in_order
from faultline.streaming.load import loaded, stream_load
from faultline.streaming.logs import stream_log_events
from faultline.streaming.sla import stream_sla, stream_trend, stream_triggers

REGISTRY = Registry()
query = REGISTRY.query
ONCE = {"availableNow": True}


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A shared table as a file stream; the pattern matches its one file."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet")


def run_out(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream until its source is used up and reads what it wrote."""
    spark = stream.sparkSession
    path = fresh_folder(spark, name)
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option(
        "checkpointLocation", f"{path}/checkpoint"
    ).trigger(**ONCE).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query(
    "STR-02",
    f"with {loads.CHUNKS_SQL} select run_id, total_rows::bigint as total_rows, rows_inserted, pct_complete, "
    "elapsed_seconds, rows_per_second, eta_seconds, sla_threshold::bigint as sla_threshold, "
    "elapsed_seconds as sla_breached_at from breaches",
)
def streamed_breaches(spark, folder):
    orders = source(spark, folder, "orders")
    elapsed = F.datediff("o_orderdate", F.lit("1995-01-01"))
    chunks = orders.select(
        F.col("o_custkey").alias("run_id"),
        (elapsed.cast("bigint") * 1_000_000_000 + F.col("o_orderkey")).alias("chunk_no"),
        F.floor("o_totalprice").cast("bigint").alias("chunk_rows"),
        elapsed.cast("double").alias("elapsed_seconds"),
        F.lit(2_000_000).cast("bigint").alias("total_rows"),
        F.lit(1500).cast("bigint").alias("sla_threshold"),
        "o_orderdate",
    )
    # orders come in any order of their dates, so none counts as late within ten years
    return run_out(stream_sla(chunks, "o_orderdate", delay="3650 days"), "breaches")


@query(
    "STR-04",
    f"with {health.TREND_SQL} select host, sample_no, trend, delta_percent from trends",
)
def streamed_trend(spark, folder):
    events = source(spark, folder, "events")
    samples = events.select(
        F.col("user_id").alias("host"),
        F.col("event_id").alias("sample_no"),
        (F.col("value") / 5).alias("ram_used_percent"),
        "ts",
    )
    return run_out(stream_trend(samples, "ts", delay="60 days"), "trend")


def dealt_at_random(rows: DataFrame, at: str, key: str, name: str) -> DataFrame:
    """The rows as a stream of four micro-batches, each with rows of all times, and of one that
    holds a single later row of another key, which moves the watermark past all others."""
    spark, path = rows.sparkSession, fresh_folder(rows.sparkSession, name)
    batch = F.pmod(F.xxhash64(*rows.columns), F.lit(4))
    # as many files per batch as the table has splits; a batch is written when the one before has ended
    files = max(1, rows.rdd.getNumPartitions())
    for i in range(4):
        part = rows.where(batch == i).repartition(files, *rows.columns)
        part.write.mode("append").parquet(f"{path}/in")
    values = {at: F.to_timestamp(F.lit("2200-01-01")), key: F.lit(-1)}
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    last = spark.range(1).select(*[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in rows.columns])
    last.write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")


@query("STR-02", REGISTRY.sql["streamed_breaches"])
def ordered_breaches(spark, folder):
    """Chunks of a run arrive in any micro-batch, and still count in their order."""
    elapsed = F.datediff("o_orderdate", F.lit("1995-01-01"))
    chunks = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("run_id"),
        (elapsed.cast("bigint") * 1_000_000_000 + F.col("o_orderkey")).alias("chunk_no"),
        F.floor("o_totalprice").cast("bigint").alias("chunk_rows"),
        elapsed.cast("double").alias("elapsed_seconds"),
        F.lit(2_000_000).cast("bigint").alias("total_rows"),
        F.lit(1500).cast("bigint").alias("sla_threshold"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
    )
    stream = dealt_at_random(chunks, "at", "run_id", "chunks")
    return run_out(stream_sla_in_order(stream, "at", delay="3650 days"), "ordered-breaches")


@query("STR-04", REGISTRY.sql["streamed_trend"])
def ordered_trend(spark, folder):
    """Samples of a host arrive in any micro-batch, and are compared in their order."""
    samples = table(spark, folder, "events").select(
        F.col("user_id").alias("host"),
        F.col("event_id").alias("sample_no"),
        (F.col("value") / 5).alias("ram_used_percent"),
        F.timestamp_seconds(F.col("event_id") + 10**9).alias("at"),  # a stream takes the epoch itself for late
    )
    stream = dealt_at_random(samples, "at", "host", "samples")
    return run_out(stream_trend_in_order(stream, "at", delay="3650 days"), "ordered-trend")


@query("STR-05", "select distinct user_id from events where event_type = 'error'")
def streamed_triggers(spark, folder):
    errors = source(spark, folder, "events").where(F.col("event_type") == "error")
    return run_out(stream_triggers(errors, ["user_id"], "ts", "60 days"), "triggers").select("user_id")


@query("STR-01 SNK-04", loads.REGISTRY.sql["first_per_key"])
def streamed_load(spark, folder):
    path = fresh_folder(spark, "stream-load")
    names = [c.strip() for c in loads.LINE_ORDER.split(",")]
    rows = source(spark, folder, "lineitem").select(
        "l_orderkey", *names, F.struct(*names).alias("place")
    )
    stream_load(rows, f"{path}/rows", f"{path}/checkpoint", "l_orderkey", "place", ONCE).awaitTermination()
    return loaded(spark, f"{path}/rows", rows.schema).drop("place")


@query("STR-03", logs.REGISTRY.sql["exported_log_events"])
def streamed_log_events(spark, folder):
    root, path = logs.written_logs(spark, folder), fresh_folder(spark, "stream-logs")
    stream_log_events(spark, root, f"{path}/rows", f"{path}/checkpoint", ONCE).awaitTermination()
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").select(
        *rules.LOG_EVENT_COLUMNS
    )
