"""Connected components by alternating large-star and small-star rounds.

Every round is a grouped minimum and a join on the node, so a node with very many
neighbours is a partial aggregate and a splittable join, never one task's list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlens.llm.common import materialize_counted


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over undirected edges (u, v): connect each node's larger (large star) or
    not larger (small star) neighbours to the least node of its neighbourhood."""
    if large:
        turned = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        turned = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = turned.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = turned.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()


def contract(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (u, v): the same components in fewer hops."""
    return _star(_star(edges, large=True), large=False)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node in ``edges`` (columns u, v): the least node reachable.

    Rounds run until the edge set no longer changes (each node then points at its
    component's least node); the number of rounds grows with the logarithm of the size.
    """
    measures = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("u", "v")))
    edges, state = materialize_counted(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), *measures)
    while state[0]:
        edges, new = materialize_counted(contract(edges), *measures)
        if new == state:
            break
        state = new
    pairs = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.unionAll(pairs.select(F.col("component").alias("id"), "component").distinct())


def labels_of(edges: DataFrame) -> DataFrame:
    """(id, component) from edges that need not be fully contracted: ids of one label are connected, but a
    component may still have several labels."""
    least = edges.select(F.greatest("u", "v").alias("id"), F.least("u", "v").alias("component"))
    least = least.unionAll(least.select(F.col("component").alias("id"), "component"))
    return least.groupBy("id").agg(F.min("component").alias("component"))
