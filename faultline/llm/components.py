"""Connected components of links, as rounds of Spark joins (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import cut


def _nearest(links: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its neighbours."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_nearest(both), "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u != v")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).where("u != v")
    least = _nearest(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reached) of every node that has a link.

    ``links`` has two columns of one orderable type.  Rounds go on until nothing changes; each is
    cut by a checkpoint.  Links stay spread over the cluster: only a count and a hash sum per
    round reach the driver.
    """
    u, v = links.columns
    now = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v").distinct()
    seen = None
    while True:
        now = cut(_small_star(_large_star(now)))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
