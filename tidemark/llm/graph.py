"""Connected components of a link table, by alternating large and small stars.

Every round is joins and minima over tables kept in the shared folder; nothing
about the graph reaches the driver but whether it is done. A star makes its
members point at the smallest member of their neighbourhood, so the depth of a
component falls by a factor in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _all_stars(edges: DataFrame) -> bool:
    """Whether every id points to one smaller id at most, and what is pointed to points nowhere."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out = 1 AND into = 1").isEmpty()


def components(links: DataFrame, space: Workspace, name: str = "components") -> DataFrame:
    """(a, b) links to (id, root): each linked id and the smallest id that links lead to.

    Links may repeat and may lead from an id to itself; ids without another one
    to link with are not in the result.
    """
    edges = space.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    k = 0
    while not _all_stars(edges):
        k += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = space.keep(large, f"{name}-{k}-edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = space.keep(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{name}-{k}")
        space.drop(f"{name}-{k - 1}", f"{name}-{k}-edges")
        edges = small
    # Done: each component is one star.
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
