"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(pairs: DataFrame) -> DataFrame:
    """u, v, m: m is the least of u and what it is linked to in ``pairs``.

    The least ones are written first: the join then reads both sides anew, and a
    hub's links can be split among tasks.
    """
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least")
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    return _stars(_both_ways(edges)).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _stars(down)
    own = stars.select("u", F.col("m").alias("v")).where("u <> v")
    return stars.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(own).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node that it reaches) for every node of a link.

    Each round writes a table of at most as many rows as there are links; rounds
    grow with the logarithm of the longest chain.  Nulls and loops link nothing.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = materialise(_small_star(materialise(_large_star(edges), "links")), "links")
        if (new := _state(edges)) == state:
            break
        state = new
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
