"""Blocks of large groups, cut at quantiles of their order.

:mod:`faultline.functions.ordered` needs a block, a coarse non-decreasing function of the sort
order.  Where the data has no such column, or all rows of a group may share its value, the limits
are taken from the rows: a group of many rows is cut at approximate quantiles of its first order
column, and rows that still share one value at those of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.ordered import sliced_join


def _below(limits: Column, value: Column, cuts: int, equal: bool) -> Column:
    """How many of the ``cuts - 1`` sorted limits lie below a value (or equal it): binary search."""
    steps, step = [], cuts // 2
    while step:
        steps.append(F.lit(step))
        step //= 2

    def further(place: Column, step: Column) -> Column:
        limit = F.get(limits, place + step - 1)
        return place + F.when(limit <= value if equal else limit < value, step).otherwise(0)

    return F.aggregate(F.array(*steps), F.lit(0), further)


def _one_value(name: str) -> Column:
    """All rows of a cell have one value, which may be null."""
    filled = F.count(name)
    return F.min(name).eqNullSafe(F.max(name)) & filled.isin(F.lit(0), F.count(F.lit(1)))


def cut_blocks(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str = "block",
    block_rows: int = 1_000_000,
    cuts: int = 1_024,
) -> DataFrame:
    """Adds ``name``, a number that never falls along ``order`` within a group of ``keys``.

    ``order`` holds ascending columns of numbers, dates or timestamps.  Groups of at most
    ``block_rows`` rows are one block.  Others fall into up to ``2 * cuts`` blocks (a power of two),
    nearly equal ones but for single values that are frequent; a block of one value and more than
    ``block_rows`` rows is cut by the next column.  Rows equal in all of ``order`` share a block.

    One row a group is counted for each column, and whether any is too large is asked while the plan is
    built, so data without large groups costs one count.  ``df`` is read up to three times per
    order column and must give the same rows each time.
    """
    if cuts < 2 or cuts & (cuts - 1):
        raise ValueError(f"cuts is a power of two, not {cuts}")
    places = [f"__o{i}" for i in range(len(order))]
    cell = F.struct(*[F.col(k) for k in keys], F.col(name))  # nulls in a struct are equal
    rows = df.withColumns({**dict(zip(places, order)), name: F.lit(0).cast("bigint")})
    shares = [F.lit(i / cuts) for i in range(1, cuts)]
    for i, place in enumerate(places):
        rows = rows.withColumn("__cell", cell)
        single = F.lit(True)
        for earlier in places[:i]:
            single = single & _one_value(earlier)
        counts = rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("__rows"), single.alias("__single"))
        crowded = counts.where(F.col("__single") & (F.col("__rows") > block_rows)).select("__cell", "__rows")
        if crowded.isEmpty():
            break
        limits = (
            rows.join(crowded.select("__cell"), "__cell", "left_semi")
            .groupBy("__cell")
            .agg(F.percentile_approx(place, F.array(*shares), F.lit(10 * cuts)).alias("__limits"))
        )
        spread = F.struct(*places)
        cut = sliced_join(rows, limits, ["__cell"], spread, counts=crowded)
        uncut = F.col("__limits").isNull() | F.col(place).isNull()  # nulls sort first
        strictly = _below(F.col("__limits"), F.col(place), cuts, False)
        inner = F.when(uncut, 0).otherwise(strictly + _below(F.col("__limits"), F.col(place), cuts, True) + 1)
        rows = cut.withColumn(name, F.col(name) * (2 * cuts) + inner).drop("__limits", "__cell")
    return rows.drop("__cell", *places)
