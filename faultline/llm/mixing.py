"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

A source's target is its share by weight of all words, but at most ``epochs`` times its size;
what a clamped source cannot take is shared again by weight among the others until none is above.
Each text of a source is taken ``floor(target / size)`` times; the rest of the target is filled
with whole texts in a seeded order, up to the text that crosses it (taken if more than half of it
fits).  So a source misses its target by at most half a text.

The seeded order is that of an md5 over seed, id and text; rows that agree in all three share a
place.  The crossing point of a source is found from sums per block of that order (``2**12``
blocks per source) and the rows of one block.  Every row then decides by comparing its own key
with its source's crossing point: texts are never shuffled, and a hot source is read in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import count_words, cut, text_or_empty

WEIGHTS = (1, 2, 3)
EPOCHS = 3
BLOCK_DIGITS = 3
SEED = "mix-1"
#: Up to this many sources, a table of one row per source is broadcast (some 20 MB).
BROADCAST_SOURCES = 200_000


def seeded_key(seed: str = SEED) -> Column:
    return F.md5(
        F.concat(
            F.lit(seed + "|"),
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            F.lit("|"),
            text_or_empty(),
        ).cast("binary")
    )


def water_fill(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``target`` for rows with ``size`` and ``weight``; rounds until no target is above its cap."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    clamped = F.lit(False)
    rest, weights, seen = total, 1, None
    while True:
        row = sizes.agg(
            F.sum(F.when(clamped, F.col("size"))).alias("s"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("w"),
            F.count(F.when(clamped, 1)).alias("n"),
        ).first()
        if row["w"] is None or row["n"] == seen:
            break
        seen, rest, weights = row["n"], total - epochs * (row["s"] or 0), row["w"]
        # in whole numbers, so that every engine clamps the same sources
        wanted = F.lit(rest).cast("decimal(20,0)") * F.col("weight").cast("decimal(10,0)")
        clamped = wanted >= F.lit(epochs * weights).cast("decimal(10,0)") * F.col("size").cast("decimal(20,0)")
    share = F.lit(rest).cast("double") * F.col("weight") / F.lit(weights).cast("double")
    return sizes.withColumn(
        "target", F.when(clamped, F.col("size").cast("double") * epochs).otherwise(share)
    )


def _small(per_source: DataFrame, most: int) -> DataFrame:
    """A table of a row per source, marked for broadcast where it is no longer than ``most``; a
    longer one is joined by shuffle, where adaptive execution splits hot sources."""
    return F.broadcast(per_source) if per_source.count() <= most else per_source


def source_plan(
    narrow: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, broadcast_sources: int = BROADCAST_SOURCES
) -> DataFrame:
    """Per source: ``source_size``, ``target``, ``whole`` repetitions and the ``last_key`` taken once more.

    ``narrow`` has ``source``, ``key`` and ``size``.
    """
    sizes = cut(narrow.groupBy("source").agg(F.sum("size").alias("size")))
    # one row per source and not per document; order by UTF-8 bytes is order by code point
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1)
    )
    plan = water_fill(cut(sizes.withColumn("weight", weight.cast("bigint"))), epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", F.least(whole, F.lit(epochs)).cast("int")).withColumn(
        "extra", F.col("target") - F.col("whole") * F.col("size")
    )
    plan = cut(plan.select(
        F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "whole", "extra"
    ))

    block = F.substring("key", 1, BLOCK_DIGITS)
    blocks = narrow.groupBy("source", block.alias("block")).agg(F.sum("size").alias("size"))
    so_far = Window.partitionBy("source").orderBy("block")
    sums = blocks.withColumn("before", F.sum("size").over(so_far) - F.col("size"))
    crossing = cut(
        sums.join(plan, sums["source"].eqNullSafe(plan["of"]))
        .where("before <= extra and extra < before + size")
        .select("of", F.col("block").alias("at"), "before", "extra")
    )
    inside = narrow.join(
        _small(crossing, broadcast_sources),
        narrow["source"].eqNullSafe(crossing["of"]) & (block == crossing["at"]),
    )
    keys = inside.groupBy("of", "key", "before", "extra", "at").agg(F.sum("size").alias("size"))
    along = Window.partitionBy("of").orderBy("key")
    end = F.col("before") + F.sum("size").over(along)
    last = (
        keys.withColumn("end", end)
        .where("2 * end - size <= 2 * extra")
        .groupBy("of")
        .agg(F.max("key").alias("key"))
    )
    bounds = crossing.select("of", "at").join(
        last.withColumnRenamed("of", "of_last"), F.col("of").eqNullSafe(F.col("of_last")), "left"
    )
    # without a text of the crossing block, all earlier blocks are taken
    bounds = bounds.select(F.col("of").alias("of_bound"), F.coalesce("key", "at").alias("bound"))
    return plan.join(bounds, F.col("of").eqNullSafe(F.col("of_bound")), "left").select(
        "of",
        "source_size",
        "target",
        "whole",
        F.when(F.col("extra") <= 0, F.lit("")).otherwise(F.coalesce("bound", F.lit("g"))).alias("last_key"),
    )


def with_repetitions(
    docs: DataFrame, plan: DataFrame, key: Column, broadcast_sources: int = BROADCAST_SOURCES
) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``times`` to rows with ``source``."""
    plan = _small(plan, broadcast_sources)
    # with nothing left to fill, last_key is empty and below every key
    joined = docs.join(plan, docs["source"].eqNullSafe(plan["of"]), "left")
    return joined.withColumn("times", F.col("whole") + (key <= F.col("last_key")).cast("int")).drop(
        "of", "whole", "last_key"
    )


def mix_sizes(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``source``, ``size`` in words, ``source_size``, ``target`` and ``times``.

    Null texts have size 0; a null source is a source of its own, the last one.  Texts without
    words cost nothing and are taken like their neighbours in the order.  An empty table gives no
    rows.
    """
    narrow = cut(
        docs.select(
            "doc_id", "source", count_words(text_or_empty()).alias("size"), seeded_key(seed).alias("key")
        )
    )
    plan = cut(source_plan(narrow, weights, epochs))
    return with_repetitions(narrow, plan, F.col("key")).drop("key")


def mixed(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it."""
    columns = docs.columns
    narrow = cut(
        docs.select("source", count_words(text_or_empty()).alias("size"), seeded_key(seed).alias("key"))
    )
    plan = cut(source_plan(narrow, weights, epochs))
    taken = with_repetitions(
        docs.select(F.struct(*columns).alias("row"), "source", seeded_key(seed).alias("key")), plan, F.col("key")
    )
    copies = taken.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select("row.*")
