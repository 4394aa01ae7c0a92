"""Product loads: progress, SLA breaches, triggers, volumes, key checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import rules
from faultline.functions.blocks import cut_blocks
from faultline.functions.numeric import rounded
from faultline.functions.ordered import first_rows, running_sums, sliced_join

RUN_KEY = ["dag_id", "task_id", "run_id"]


def progress(
    chunks: DataFrame,
    key: list[str],
    block: str | None,
    order: list[Column],
    rows: str = "chunk_rows",
    digits: int | None = 1,
    final_row: bool = False,
) -> DataFrame:
    """State of a load just before each chunk: rows so far, share, speed, ETA.

    ``chunks`` has ``elapsed_seconds`` and ``total_rows``.  ``block`` is a coarse
    non-decreasing function of ``order`` (chunk number / 1000); without one, large loads are
    cut at quantiles.  With ``final_row``
    the chunk itself counts as loaded, which also shows a breach in the last chunk.
    """
    columns = chunks.columns
    if block is None:
        chunks, block = cut_blocks(chunks, key, order, "__block"), "__block"
    summed = running_sums(
        chunks, key, block, order, {"rows_inserted": F.col(rows)}, inclusive=final_row
    )
    elapsed, done = F.col("elapsed_seconds"), F.col("rows_inserted").cast("double")
    total = F.col("total_rows")
    speed = F.coalesce(
        F.when(elapsed > 0, done / F.nullif(elapsed, F.lit(0.0))), F.lit(0.0)
    )
    staged = summed.withColumn("__speed", speed)
    left = (total - F.col("rows_inserted")) / F.nullif(F.col("__speed"), F.lit(0.0))
    share = F.col("rows_inserted") * 100.0 / F.nullif(total.cast("double"), F.lit(0.0))
    return staged.withColumns(
        {
            "pct_complete": rounded(F.coalesce(share, F.lit(0.0)), digits),
            "rows_per_second": rounded(F.col("__speed"), digits),
            "eta_seconds": rounded(
                F.coalesce(F.when(F.col("__speed") > 0, left), F.lit(0.0)), digits
            ),
        }
    ).drop("__speed", *{block} - set(columns))


def first_breach(
    progressed: DataFrame, key: list[str], order: list[Column], digits: int | None = 1
) -> DataFrame:
    """The first moment at which each run was over its SLA.

    Filter first, then one row per run; map tasks keep one row per run each.
    """
    over = progressed.where(F.col("elapsed_seconds") > F.col("sla_threshold"))
    first = first_rows(over, key, order, 1, "__rank")
    return first.select(
        *key,
        "total_rows",
        "rows_inserted",
        "pct_complete",
        rounded(F.col("elapsed_seconds"), digits).alias("elapsed_seconds"),
        "rows_per_second",
        "eta_seconds",
        "sla_threshold",
        rounded(F.col("elapsed_seconds"), digits).alias("sla_breached_at"),
        *[c for c in ("chunk_size", "insert_method", "data_volume") if c in first.columns],
    )


def first_trigger(events: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One analysis per run: its first breach or failure."""
    return first_rows(events, key, order, 1, "__rank").drop("__rank")


def union_loads(loads: dict[str, DataFrame]) -> DataFrame:
    """Rows of several load volumes with a volume tag."""
    tagged = [df.withColumn("data_volume", F.lit(tag)) for tag, df in loads.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def key_counts(products: DataFrame, key: str) -> DataFrame:
    """Rows per key, whether it repeats, and the size of the table."""
    counted = products.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows"))
    total = products.agg(F.count(F.lit(1))).scalar()
    return counted.select(
        key,
        "key_rows",
        (F.col("key_rows") > 1).alias("duplicate_detected"),
        total.alias("total_rows"),
    )


def _price(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.nullif(value, F.lit(0.0)).alias(column)


def product_check(
    products: DataFrame, errors: DataFrame, spread: Column, slice_rows: int = 2_000_000
) -> DataFrame:
    """Product evidence for errors that name a product id.

    Runs after the log evidence, so it sees the ids found there.  The product table
    is cut down to the named ids before it is grouped or joined, and one product
    named by very many errors is split into slices.
    """
    asked = errors.withColumn("__id", F.col("product_id").try_cast("bigint"))
    named = asked.select(F.col("__id").alias("__key")).where(F.col("__key").isNotNull()).distinct()
    rows = products.join(named, products["product_id"] == named["__key"], "left_semi")
    found = rows.groupBy(F.col("product_id").alias("__id")).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.min(
            F.struct(
                "product_name", "brand", "category", "supplier_id",
                _price("cost_price"), _price("selling_price"),
            )
        ).alias("__product"),
    )
    total = products.agg(F.count(F.lit(1))).scalar()
    joined = sliced_join(asked, found, ["__id"], spread, "left", slice_rows)
    return joined.select(
        *errors.columns,
        F.col("__rows").isNotNull().alias("exists"),
        "__product.product_name",
        "__product.brand",
        "__product.category",
        "__product.supplier_id",
        "__product.cost_price",
        "__product.selling_price",
        (F.coalesce("__rows", F.lit(0)) > 1).alias("duplicate_detected"),
        total.alias("total_rows"),
    )
