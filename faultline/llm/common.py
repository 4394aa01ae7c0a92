"""What the operators share: reading, shipping code, and text buffers as NumPy arrays."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the contracts that split at white space, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_shipped: set[str] = set()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="ship-"), "faultline_package")
    made = shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(made)
    _shipped.add(context.applicationId)


def shared(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local master, as in tests, may go without: it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder: computed once, and safe from lost executors."""
    shared(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """A row without an id is never held out; it cannot be learned from either, as no label names it."""
    return F.coalesce(remainder(doc_id, modulus) == rest, F.lit(False))


def bounded_choice(ids: DataFrame, bound: int, by: str | None = None) -> DataFrame:
    """At most ``bound`` of the distinct rows of ``ids`` for each value of ``by``, or in all: the
    first by a hash of ``doc_id``.

    Hashes are counted by their number of binary digits first.  Only rows whose hash is short
    enough for ``bound`` rows, about twice as many at most, are then ranked; so no task sees all
    rows of a value, however common it is.
    """
    group = F.col(by) if by else F.lit(0)
    digits = F.length(F.bin("__hash"))
    rows = ids.distinct().select(
        "*", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1)).alias("__hash"), group.alias("__group")
    )
    counts = rows.groupBy("__group", digits.alias("__digits")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("__group").orderBy("__digits")
    limits = (
        counts.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        .where(F.col("before") < bound)
        .groupBy("__group")
        .agg(F.max("__digits").alias("__most"))
    )
    order = Window.partitionBy("__group").orderBy("__hash", *ids.columns)
    return (
        rows.join(limits, "__group")  # one row per value, which Spark sends to the rows
        .where(digits <= F.col("__most"))
        .withColumn("__rank", F.row_number().over(order))
        .where(F.col("__rank") <= bound)
        .select(ids.columns)
    )


def set_aside(docs: DataFrame, *names: str):
    """``docs`` with its columns of these names (in any case) renamed, and a function that returns
    rows made from them to the columns of ``docs``."""
    taken = {n.lower() for n in names}
    other = {c: f"__aside_{i}" if c.lower() in taken else c for i, c in enumerate(docs.columns)}

    def back(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{new}`").alias(old) for old, new in other.items()])

    return docs.select(*[F.col(f"`{old}`").alias(new) for old, new in other.items()]), back


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def count_words(text: Column) -> Column:
    """Words of ``WORD`` without building an array: each word becomes one letter."""
    letters = F.regexp_replace(text, WORD, "x")
    return F.length(F.regexp_replace(letters, GAP, "")).cast("bigint")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more at the end); null is empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges with at most ``limit`` bytes of text each; a longer text stands alone."""
    if not len(column):
        return
    _, offsets = buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last
        first = last
