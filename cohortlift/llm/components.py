"""Connected components of links, as rounds of joins and minimum aggregates.

Edges are rewired until every node points at the smallest node that it can reach (alternating large
and small stars). A round only needs each node's smallest neighbour, which is aggregated on the map
side, so a hub with a third of all edges is no group that any task must hold. Rounds are cut by
written tables, so a lost executor costs no recomputation from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.sources.tables import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u"), F.col("v")).unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Links may be repeated, in either direction or from a node to itself; links with a null end
    are ignored. No links give an empty table.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = staged(edges.where("u <> v").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = staged(_small_star(_large_star(edges)), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    low = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(low)


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges: equal when a round changed nothing."""
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) % 1000003"))).first()
    return tuple(row)
