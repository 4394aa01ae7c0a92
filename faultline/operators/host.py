"""Host metrics: memory trend and health grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import rules
from faultline.functions.blocks import cut_blocks
from faultline.functions.numeric import rounded
from faultline.functions.ordered import trailing_frame


def trend_label(delta: Column, samples: Column, band: float = rules.TREND_BAND) -> Column:
    return (
        F.when(samples < 2, "INSUFFICIENT_DATA")
        .when(delta > band, "RISING")
        .when(delta < -band, "FALLING")
        .otherwise("STABLE")
    )


def trend(
    samples: DataFrame,
    key: list[str],
    block: str | None,
    order: list[Column],
    value: str = "ram_used_percent",
    n: int = rules.TREND_SAMPLES,
    band: float = rules.TREND_BAND,
    digits: int | None = 2,
    block_rows: int = 100_000,
) -> DataFrame:
    """Memory trend at each sample: last minus first of the last ``n`` samples.

    ``block`` is a coarse time (the day); without one, hosts of more than ``block_rows``
    samples are cut at quantiles of ``order``.  A host with very many samples is cut into
    even slices with an overlap of ``n - 1`` rows.
    """
    columns = samples.columns
    if block is None:
        samples = cut_blocks(samples, key, order, "__block", block_rows)
        block = "__block"
    framed = trailing_frame(
        samples,
        key,
        block,
        order,
        n,
        {
            "__first": lambda w: F.first_value(value).over(w),
            "__samples": lambda w: F.count(F.lit(1)).over(w),
        },
        block_rows,
    )
    delta = F.col(value) - F.col("__first")
    enough = F.col("__samples") >= 2
    return framed.withColumns(
        {
            "trend": trend_label(delta, F.col("__samples"), band),
            "delta_percent": F.when(enough, rounded(delta, digits)).otherwise(F.lit(0.0)),
        }
    ).drop("__first", "__samples", *{block} - set(columns))


def cpu_health(percent: Column, load: Column, cores: Column, iowait: Column) -> Column:
    """Grade of processor use; missing load and wait count as 0, cores as 1."""
    load, iowait = F.coalesce(load, F.lit(0.0)), F.coalesce(iowait, F.lit(0.0))
    cores = F.coalesce(F.nullif(cores, F.lit(0)), F.lit(1))

    def over(limit: dict) -> Column:
        return (
            (percent > limit["percent"])
            | (load > cores * limit["load_per_core"])
            | (iowait > limit["iowait"])
        )

    return (
        F.when(over(rules.CPU_CRITICAL), "CRITICAL")
        .when(over(rules.CPU_WARNING), "WARNING")
        .otherwise("HEALTHY")
    )


def memory_health(ram: Column, swap: Column, oom: Column, trend_name: Column) -> Column:
    top, mid = rules.MEMORY_CRITICAL, rules.MEMORY_WARNING
    oom = F.coalesce(oom, F.lit(False))
    return (
        F.when((ram > top["ram"]) | (swap > top["swap"]) | oom, "CRITICAL")
        .when((ram > mid["ram"]) | (swap > mid["swap"]), "WARNING")
        .when(trend_name == "RISING", "MONITOR")
        .otherwise("HEALTHY")
    )


def health_rank(grade: Column) -> Column:
    ranks = F.lit(0)
    for name, rank in rules.HEALTH_RANKS.items():
        ranks = F.when(grade == name, F.lit(rank)).otherwise(ranks)
    return ranks


def health_name(rank: Column) -> Column:
    named = F.lit("HEALTHY")
    for name, number in rules.HEALTH_RANKS.items():
        named = F.when(rank == number, F.lit(name)).otherwise(named)
    return named


def overall_health(*grades: Column) -> Column:
    """The worst of several grades; UNKNOWN and other grades weigh nothing."""
    return health_name(F.greatest(*[health_rank(g) for g in grades]))


def worst_health(grades: DataFrame, by: list[str], grade: str) -> DataFrame:
    """The worst grade per group."""
    return grades.groupBy(*by).agg(
        health_name(F.max(health_rank(F.col(grade)))).alias("overall_health")
    )
