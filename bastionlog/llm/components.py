"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bastionlog.session import materialise


def _mirrored(links: DataFrame) -> DataFrame:
    return links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _lowest(links: DataFrame) -> DataFrame:
    """Per node the smallest of its neighbours and itself; partial minima come before the shuffle."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame, name: str) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour.

    The minima are written first, so that both sides of the join come straight from a shuffle: only then
    does the planner split the rows of a node that has a large share of all links.
    """
    both = _mirrored(links)
    return both.join(materialise(_lowest(both), name), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are hung on the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(lowest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(lowest.select("u", F.col("m").alias("v")))


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) of every linked node; the root is the smallest node of its component, and leads itself
    to no row. ``links`` has two columns u, v of one ordered type; self links and repeats are allowed.

    Each round is written to the shared folder, so lineage does not grow and lost executors cost one round.
    """
    now = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = materialise(now, name), None
    while True:
        stars = _small_star(_large_star(now, name)).filter("u <> v").distinct()
        now = materialise(stars, name)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
