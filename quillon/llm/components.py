"""Connected components over a DataFrame of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import checkpointed


def large_star(links: DataFrame) -> DataFrame:
    """(hi, lo) with the same components: each node's larger neighbours are linked to the least of it and its neighbours."""
    near = links.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(links.select("lo", "hi"))
    least = near.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    return links.join(least, links["lo"] == least["node"]).select("hi", F.col("least").alias("lo")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """(hi, lo) with the same components: each node and its smaller neighbours are linked to the least of these."""
    least = links.groupBy("hi").agg(F.min("lo").alias("least"))
    own = least.select("hi", F.col("least").alias("lo"))
    others = links.join(least, "hi").where(F.col("lo") != F.col("least")).select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return own.union(others).distinct()


def _state(links: DataFrame) -> tuple:
    """Two sums that tell one set of links from another."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head())


def min_labels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label): for every node that has a link to another, the smallest node of its component.

    Links are turned to larger and smaller end, then large and small stars are
    made in turn until the links are one star around each component's least
    node. A round never has more links than the one before, a least neighbour is
    a partial aggregate and joins give a row for each link, so a hub costs what
    its links cost. Each round is checkpointed; two sums reach the driver.
    """
    ends = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
    links = checkpointed(ends.distinct())  # what finds the links runs once
    links = checkpointed(small_star(links))
    state = _state(links)
    while state[0]:
        links = checkpointed(small_star(large_star(links)))
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(roots)
