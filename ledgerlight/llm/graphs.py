"""Connected components of links by alternating stars; only DataFrame joins and sums, no driver state.

With many links the least neighbours are written before they are joined with the links: so
a node with very many links is an ordinary large group of a join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


#: Links from which the least neighbours are written, so that a large star can be split; below, all of them make one small task.
SPLIT = 1_000_000


def _large(edges: DataFrame, held: list | None) -> DataFrame:
    """Links of every larger neighbour of a node to the least of its neighbourhood. ``held`` takes tables written in between."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = _kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), held)
    turned = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return turned if held is None else turned.distinct()  # the other half of the round drops repeated links itself


def _small(edges: DataFrame, held: list | None) -> DataFrame:
    """Links of a node and its smaller neighbours to the least of them. Edges point from larger to smaller."""
    least = _kept(edges.groupBy("a").agg(F.min("b").alias("m")), held)
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def _kept(least: DataFrame, held: list | None) -> DataFrame:
    if held is None:
        return least
    held.append(cut(least, "least"))
    return held[-1]


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, for every node of ``links`` (two columns of longs).

    Rounds go on until one changes nothing; their number grows with the logarithm of the
    longest chain. Tables of earlier rounds are deleted.
    """
    a, b = links.columns
    edges = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    mark = _mark(edges)
    while True:
        held = [] if mark[0] > SPLIT else None
        turned = _large(edges, held)
        if held is not None:
            held.append(cut(turned, "links"))
            turned = held[-1]
        after = cut(_small(turned, held), "links")
        now = _mark(after)
        release(edges, *(held or ()))
        edges = after
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
        mark = now
