"""Ordered computations over groups that may be very large.

A plain window puts a whole group into one task.  Here the caller names a *block*:
a coarse, non-decreasing function of the sort order (a day, a chunk number divided
by 1000, a file split).  Each block of a group is ordered on its own; what earlier
blocks contribute is one aggregate row per block, so the only window over a whole
group runs over its block rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[prefix + key])
    return condition


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left"
) -> DataFrame:
    """Equi-join in which null keys match; key columns come from the left."""
    prefix = "__r_"
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, prefix + key)
    joined = left.join(renamed, _same(left, renamed, keys, prefix), how)
    return joined.drop(*[prefix + key for key in keys])


def block_prefix(
    df: DataFrame, keys: list[str], block: str, sums: dict[str, Column]
) -> DataFrame:
    """Per group and block, the sums over all earlier blocks of the group."""
    totals = df.groupBy(*keys, block).agg(
        *[F.sum(value).alias(name) for name, value in sums.items()]
    )
    window = (
        Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)]))
        .orderBy(block)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *keys,
        block,
        *[
            F.coalesce(F.sum(name).over(window), F.lit(0)).alias(name)
            for name in sums
        ],
    )


def running_sums(
    df: DataFrame,
    keys: list[str],
    block: str,
    order: list[Column],
    sums: dict[str, Column],
    inclusive: bool = True,
) -> DataFrame:
    """Running sums along the order of each group.

    ``order`` must be unique within a group.  The two shuffles are by group and
    block; the second moves aggregate rows only.
    """
    staged = df.withColumns({f"__v_{name}": value for name, value in sums.items()})
    earlier = block_prefix(
        staged, keys, block, {f"__p_{name}": F.col(f"__v_{name}") for name in sums}
    )
    end = Window.currentRow if inclusive else -1
    window = (
        Window.partitionBy(*keys, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    local = staged.withColumns(
        {
            f"__l_{name}": F.coalesce(F.sum(f"__v_{name}").over(window), F.lit(0))
            for name in sums
        }
    )
    joined = null_safe_join(local, earlier, [*keys, block], "inner")
    result = joined.withColumns(
        {name: F.col(f"__p_{name}") + F.col(f"__l_{name}") for name in sums}
    )
    scratch = [f"__{part}_{name}" for part in "vpl" for name in sums]
    return result.drop(*scratch)


def row_index(
    df: DataFrame, keys: list[str], block: str, order: list[Column], name: str
) -> DataFrame:
    """1-based position of each row within its group."""
    return running_sums(df, keys, block, order, {name: F.lit(1).cast("bigint")})


def trailing_frame(
    df: DataFrame,
    keys: list[str],
    block: str,
    order: list[Column],
    rows: int,
    frame: dict,
    block_rows: int = 100_000,
) -> DataFrame:
    """Window expressions over the last ``rows`` rows, current row included.

    ``frame`` maps a column name to a function from a window to a Column.  Rows are
    numbered per group, cut into even slices, and each slice gets a copy of the
    ``rows - 1`` rows before it, so a task holds one slice and not one group.
    """
    numbered = row_index(df, keys, block, order, "__index")
    position = F.col("__index") - 1
    slice_no = F.floor(position / block_rows)
    reaches_next = (position % block_rows) > block_rows - rows
    slices = F.when(
        reaches_next, F.array(slice_no, slice_no + 1)
    ).otherwise(F.array(slice_no))
    copied = numbered.withColumn("__home", slice_no).withColumn(
        "__slice", F.explode_outer(slices)
    )
    window = (
        Window.partitionBy(*keys, "__slice")
        .orderBy("__index")
        .rowsBetween(-(rows - 1), Window.currentRow)
    )
    framed = copied.withColumns({name: make(window) for name, make in frame.items()})
    return framed.where(F.col("__home") == F.col("__slice")).drop(
        "__home", "__slice", "__index"
    )


def first_rows(
    df: DataFrame, keys: list[str], order: list[Column], limit: int, name: str
) -> DataFrame:
    """The first rows of each group with their rank.

    The rank filter lets Spark keep only ``limit`` rows per group and map task
    before the shuffle, so a hot group does not travel whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window))
    return ranked.where(F.col(name) <= limit)


def sliced_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread: Column,
    how: str = "left",
    slice_rows: int = 2_000_000,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join in which one key may hold a large share of the fact rows.

    Keys with more than ``slice_rows`` fact rows are split into slices by a hash of
    ``spread`` (any deterministic value that differs between rows); the lookup rows
    of those keys alone are repeated once per slice.  Spark decides by the size of the
    list of such keys (at most ``fact rows / slice_rows``) how to join it.  Rows with a
    null key match nothing and are spread freely.  ``counts`` (the keys and
    ``__rows``) saves the counting pass where the caller has the counts already.
    """
    if counts is None:
        counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    counted = counts.where(F.col("__rows") > slice_rows)
    hot = counted.select(*keys, F.ceil(F.col("__rows") / slice_rows).alias("__slices"))
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    left = facts.join(hot, keys, "left").withColumn(
        "__slice",
        F.pmod(
            F.xxhash64(spread),
            F.when(no_key, F.lit(4096)).otherwise(F.coalesce("__slices", F.lit(1))),
        ).cast("bigint"),
    )
    right = lookup.join(hot, keys, "left").withColumn(
        "__slice",
        F.explode_outer(
            F.sequence(
                F.lit(0).cast("bigint"), F.coalesce("__slices", F.lit(1)).cast("bigint") - 1
            )
        ),
    )
    return (
        left.drop("__slices")
        .join(right.drop("__slices"), [*keys, "__slice"], how)
        .drop("__slice")
    )
