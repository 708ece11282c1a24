"""Connected components of an edge table, by alternating star contractions.

Each round is two aggregate-join steps (``min`` per node, joined back on the node), so a hub node is
pre-aggregated on the map side and its join partition can be split by adaptive skew handling. Rounds
grow with the logarithm of the longest path. No node list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgraph.session import staged


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every node of ``edges``; component = smallest node reachable.

    Edges are undirected; self-loops, repeats and null ends are allowed (a node that has only
    self-loops is its own component, a null end is ignored). An empty table gives an empty result.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    pairs = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = staged(pairs.distinct())
    loops = current.where("u = v").select(F.col("u").alias("node"))
    links = current.where("u <> v")
    before = _signature(links)
    if before[0] == 0:
        return loops.select("node", F.col("node").alias("component"))
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        links = staged(small.select("e.u", "e.v").where("u <> v").distinct())
        after = _signature(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    tops = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    alone = loops.join(roots.select("node").union(tops.select("node")), "node", "left_anti")
    return roots.unionByName(tops).unionByName(alone.select("node", F.col("node").alias("component")))
