"""Face adjacency between regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelgraph.operators import bricks
from voxelgraph.session import staged


def shared_faces(labelled: DataFrame) -> DataFrame:
    """``(case_id, lo, hi, shared_faces)``: faces between two different labels above 0, counted brick by brick."""
    return bricks.face_counts(labelled)


def shared_faces_between(faces: DataFrame, a: int, b: int) -> DataFrame:
    """The face count of one pair, per case."""
    return faces.where((F.col("lo") == min(a, b)) & (F.col("hi") == max(a, b)))


def region_means(labelled: DataFrame, value: str) -> DataFrame:
    return labelled.where("label > 0").groupBy("case_id", "label").agg(F.avg(value).alias("mean"))


def full_adjacency(labelled: DataFrame, value: str) -> DataFrame:
    """``(case_id, lo, hi, shared_faces, mean_diff)`` for every pair of adjacent regions."""
    found = staged(bricks.faces_and_means(labelled, F.col(value)))
    means = found.where("lo = hi")
    a, b = means.select("case_id", "lo", F.col("mean").alias("mean_lo")), means.select("case_id", "hi", F.col("mean").alias("mean_hi"))
    joined = found.where("lo < hi").select("case_id", "lo", "hi", F.col("n").alias("shared_faces")).join(a, ["case_id", "lo"]).join(b, ["case_id", "hi"])
    return joined.select("case_id", "lo", "hi", "shared_faces", F.abs(F.col("mean_lo") - F.col("mean_hi")).alias("mean_diff"))


def adjacency(labelled: DataFrame, value: str, alpha: float) -> DataFrame:
    """Pairs whose means differ by at most alpha: a filter over the full adjacency."""
    return full_adjacency(labelled, value).where(F.col("mean_diff") <= alpha)


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (``case_id, label``)."""
    lo, hi = (nodes.select("case_id", F.col("label").alias(c)).distinct() for c in ("lo", "hi"))
    return edges.join(lo, ["case_id", "lo"], "left_semi").join(hi, ["case_id", "hi"], "left_semi")


def bidirectional(edges: DataFrame) -> DataFrame:
    """Each undirected edge both ways, as ``src`` and ``dst``, in one pass."""
    ways = F.explode(F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst"))))
    return edges.withColumn("__e", ways).select(*(c for c in edges.columns if c not in ("lo", "hi")), "__e.src", "__e.dst")


def dense_index(nodes: DataFrame) -> DataFrame:
    """Add ``idx``: 0, 1, ... for each case in order of the labels."""
    return nodes.withColumn("idx", (F.row_number().over(Window.partitionBy("case_id").orderBy("label")) - 1).cast("bigint"))


def edge_sparsity(cases: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per case: nodes, edges, edges per node, and whether there is no edge at all."""
    v = nodes.groupBy("case_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("case_id").agg(F.count("*").alias("edges"))
    out = cases.select("case_id").join(v, "case_id", "left").join(e, "case_id", "left").fillna(0, ["nodes", "edges"])
    return out.withColumn("ratio", F.col("edges") / F.greatest("nodes", F.lit(1))).withColumn("no_edges", F.col("edges") == 0)
