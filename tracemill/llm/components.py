"""Connected components of a distributed link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.blocks import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its larger neighbours."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")))
    joined = both.join(least, "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its other smaller neighbours."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = cut_lineage(down.groupBy("u").agg(F.min("v").alias("m")))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v) that is not itself the smallest of its component.

    The component is the smallest node that can be reached.  Minima per node are
    written out before they meet the links again: both sides of that join are plain
    exchanges, so adaptive execution splits a node with very many links over tasks.
    """
    seen = None
    while True:
        links = cut_lineage(_small_star(_large_star(links)))
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or now[0] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
