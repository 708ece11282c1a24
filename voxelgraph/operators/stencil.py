"""Neighbourhood expressions over voxel tables: surfaces, gradients, markers, slices.

Windows run along one grid line (case and two coordinates), so no partition exceeds a line's length; what looks
at all neighbours takes bricks with a halo, which costs one shuffle in place of three.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from voxelgraph.operators import bricks

AXES = ("x", "y", "z")


def line(axis: str) -> WindowSpec:
    """The grid lines along an axis."""
    return Window.partitionBy("case_id", *(a for a in AXES if a != axis)).orderBy(axis)


def neighbour(value: Column, axis: str, step: int) -> Column:
    """``value`` one voxel further along an axis (step 1 or -1); null outside the volume or where a voxel is missing."""
    w, get = line(axis), F.lead if step > 0 else F.lag
    return F.when(get(axis, 1).over(w) == F.col(axis) + step, get(value, 1).over(w))


def with_surfaces(voxels: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Add a boolean for each mask: in it, with a face neighbour outside it or outside the volume. One shuffle for all."""
    held, n = [F.coalesce(m, F.lit(False)) for m in masks.values()], len(masks)
    return bricks.on_bricks(voxels, held, lambda brick: bricks.surface(*(brick.array(k, False) for k in range(n))), ", ".join(f"`{n}` boolean" for n in masks))


def with_surface(voxels: DataFrame, mask: Column, name: str = "surface") -> DataFrame:
    """``with_surfaces`` of one mask."""
    return with_surfaces(voxels, {name: mask})


def gradient_magnitude(voxels: DataFrame, value: str, name: str = "gradient") -> DataFrame:
    """Add the 3-D Sobel magnitude: [1, 2, 1] / 4 smoothing on two axes, [1, 0, -1] / 2 difference on the third,
    reflected borders, root mean square of the three."""
    return bricks.on_bricks(voxels, [F.col(value).cast("double")], lambda brick: bricks.sobel(brick.array(0, np.nan)), f"`{name}` double")


def lattice_markers(voxels: DataFrame, stride: int, where: Column | None = None, first: int = 1) -> DataFrame:
    """``(case_id, lin, marker)`` at every stride-th voxel of each axis, numbered in raster order for each case."""
    on = F.lit(True)
    for axis in AXES:
        on = on & (F.col(axis) % stride == 0)
    kept = voxels.where(on if where is None else on & where)
    return kept.select("case_id", "lin", (F.row_number().over(Window.partitionBy("case_id").orderBy("lin")) - 1 + first).cast("bigint").alias("marker"))


def label_boundary_2d(labels: DataFrame) -> DataFrame:
    """Add ``edge``: within a slice the label differs from the previous one along x or y."""
    differs = [F.coalesce(neighbour(F.col("label"), a, -1) != F.col("label"), F.lit(False)) for a in ("x", "y")]
    return labels.withColumn("edge", differs[0] | differs[1])


def best_slice(voxels: DataFrame, k: int = 5) -> DataFrame:
    """``(case_id, z, n, before, after)``: the slice with most tumour voxels (lowest on a tie), and k away, clamped."""
    by = voxels.groupBy("case_id", "z").agg(F.sum((F.col("seg") == 2).cast("bigint")).alias("n"))
    top = by.groupBy("case_id").agg(F.max(F.struct("n", (-F.col("z")).alias("back"))).alias("t"), F.max("z").alias("last"))
    at = -F.col("t.back")
    return top.select("case_id", at.cast("int").alias("z"), F.col("t.n").alias("n"), F.greatest(at - k, F.lit(0)).cast("int").alias("before"), F.least(at + k, F.col("last")).cast("int").alias("after"))
