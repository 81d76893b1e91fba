"""Connected components by alternating stars.

Every round is a few joins and minimum aggregations over the edge table, and
is written to the shared folder.  Nothing but counts reaches the driver, and
no neighbour list is ever gathered: a hub with millions of edges is a join key
with one small row on the other side.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunFolder


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least node in its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them (u > v holds)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    kept = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, run: RunFolder, max_rounds: int = 100) -> DataFrame:
    """(u, root) for every node that is not the least of its component.

    ``edges`` has the columns u and v of one orderable type.  Self loops, repeated
    edges and edges with a null end are ignored.  No edges: an empty table.
    Raises if ``max_rounds`` do not suffice (rounds grow with the logarithm of the
    component size).
    """
    oriented = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, before = run.write(oriented, "cc0"), None
    for i in range(max_rounds):
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            return current.select("u", F.col("v").alias("root"))
        before = state
        current = run.write(_small_star(_large_star(current)), f"cc{i + 1}")
        run.drop(f"cc{i}")
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
