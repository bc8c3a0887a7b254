"""Connected components of a graph given as link rows, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, scratch_path, spread_join, written


def _lowest(links: DataFrame) -> DataFrame:
    """Each node u with the smallest of itself and its neighbours v, and the number of these."""
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = spread_join(both, _lowest(both), "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = _lowest(down)
    joined = spread_join(down, lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """From link rows (u, v): rows (node, root) for every node that is no root; root is the component's smallest node.

    Each half of a round is a few joins on node ids and is written to the shared folder; the state
    before it is dropped then. A star's centre is a hot key, which its joins spread. It ends when a
    round changes nothing; only a count and a checksum reach the driver.
    """
    spark = links.sparkSession

    def kept(rows: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "links")
        return written(rows, "links", path), path

    (state, path), seen = kept(links.where("u <> v").distinct()), None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        for star in (_large_star, _small_star):
            after, after_path = kept(star(state))
            drop_table(spark, path)
            state, path = after, after_path
