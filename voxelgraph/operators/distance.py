"""Exact Euclidean distances to a mask.

The squared distance is separable: along z and y inside slabs of whole planes, then along x over whole lines. Each
axis takes, line by line, the lower envelope of the parabolas that stand on the line's voxels, in time linear in
its length. Two shuffles deal the voxels, by slab and by rows of lines; a group is some planes or some bundles of
lines, never a volume; where all volumes are smaller than that, one shuffle does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voxelgraph.operators.bricks import AXES
from voxelgraph.session import ship, staged

#: Voxels that a group has at most, about, where a plane or a bundle of single lines isn't larger.
GROUP = 1 << 17
#: Where a volume is one group and has no more pairs of asked and mask voxels than this, the pairs are measured instead.
PAIRS = 1 << 19


def envelope(f: np.ndarray, step: float) -> np.ndarray:
    """For each line (a row of ``f``, squared heights, inf where there is none) the least of f[q] + (step * (p - q))^2 over q, at each p.

    All lines go through their positions together: a stack for each line holds the parabolas of its envelope.
    """
    lines, n = f.shape
    place = np.zeros((lines, n), "i4")  # positions of the parabolas in the envelope
    begin = np.full((lines, n + 1), np.inf)  # where each starts to be the lowest
    top = np.full(lines, -1)
    square = (np.arange(n) * step) ** 2
    for q in range(n):
        todo = np.flatnonzero(np.isfinite(f[:, q]))
        while len(todo):
            t = top[todo]
            first = t < 0
            last = place[todo, np.maximum(t, 0)]
            with np.errstate(invalid="ignore", divide="ignore"):
                cross = ((f[todo, q] + square[q]) - (f[todo, last] + square[last])) / (2 * step * step * (q - last))
            cross = np.where(first, -np.inf, cross)
            lower = ~first & (cross <= begin[todo, np.maximum(t, 0)])
            stays, at = todo[~lower], top[todo[~lower]] + 1
            place[stays, at], begin[stays, at], top[stays] = q, cross[~lower], at
            todo = todo[lower]
            top[todo] -= 1
    out = np.full((lines, n), np.inf)
    some = np.flatnonzero(top >= 0)
    now = np.zeros(lines, "i8")
    for p in range(n):
        go = some
        while len(go):
            go = go[(now[go] < top[go])]
            go = go[begin[go, now[go] + 1] <= p]
            now[go] += 1
        q = place[some, now[some]]
        out[some, p] = f[some, q] + (step * (p - q)) ** 2
    return out


def _along(values: np.ndarray, axis: int, step: float) -> np.ndarray:
    moved = np.moveaxis(values, axis, -1)
    flat = np.ascontiguousarray(moved).reshape(-1, moved.shape[-1])
    some = np.flatnonzero(np.isfinite(flat).any(1))
    out = np.full(flat.shape, np.inf)
    if len(some):
        out[some] = envelope(flat[some], step)
    return np.moveaxis(out.reshape(moved.shape), -1, axis)


def _pass(rows: DataFrame, key: Column, axes: tuple[int, ...], last: bool) -> DataFrame:
    """``rows`` with ``__d`` after the passes along ``axes``; groups hold whole lines of these axes. The last pass returns no spacing."""
    spacing = [f"__s{a}" for a in AXES] if last else []
    schema = StructType([f for f in rows.schema if f.name not in ("__d", *spacing)] + [StructField("__d", DoubleType())])
    names, most = [f.name for f in schema][:-1], PAIRS if len(axes) == len(AXES) else 0

    def run(table: pa.Table) -> pa.Table:
        at = [table.column(a).to_numpy() for a in AXES]
        ask, mask = np.flatnonzero(table.column("__ask").to_numpy()), np.flatnonzero(table.column("__d").is_valid().to_numpy())
        if len(ask) * len(mask) <= most:
            found = np.full(table.num_rows, np.nan)
            if len(ask) and len(mask):
                # the axes in the order of the passes, so that both ways round alike
                squares = ((float(table.column(f"__s{AXES[k]}")[0].as_py()) * (at[k][ask][:, None] - at[k][mask])) ** 2 for k in axes)
                found[ask] = sum(squares).min(1)
            return table.select(names).append_column("__d", pa.array(found, from_pandas=True))
        low = [int(a.min()) for a in at]
        shape = tuple(int(a.max()) - f + 1 for a, f in zip(at, low, strict=True))
        place = np.ravel_multi_index([a - f for a, f in zip(at, low, strict=True)], shape)
        d = np.full(shape, np.inf)
        d.ravel()[place] = table.column("__d").fill_null(np.inf).to_numpy()
        asked = table.column("__ask").to_numpy()
        if np.isfinite(d).any() and (asked.any() or not last):
            for axis in axes:
                d = _along(d, axis, float(table.column(f"__s{AXES[axis]}")[0].as_py()))
        found = d.ravel()[place]
        return table.select(names).append_column("__d", pa.array(np.where(np.isfinite(found), found, np.nan), from_pandas=True))

    return rows.withColumn("__g", key).groupBy("case_id", "__g").applyInArrow(run, schema)


def with_distance(voxels: DataFrame, query: Column, mask: Column, cases: DataFrame, asked: bool = False) -> DataFrame:
    """``voxels`` with ``distance`` in mm, null where ``query`` doesn't hold or the case has no mask.

    Voxels are spaced by the case's ``sx, sy, sz``. ``asked``: return only those where ``query`` holds; where a
    volume is one group, those of neither query nor mask then stay where they are.
    """
    ship(voxels.sparkSession, numbers=True)
    dims = cases if "nx" in cases.columns else cases.join(voxels.groupBy("case_id").agg(*((F.max(a) + 1).alias(f"n{a}") for a in AXES)), "case_id")
    about = staged(dims.select("case_id", *(F.col(f"{k}{a}").alias(f"__{k}{a}") for k in ("n", "s") for a in AXES)))
    nx, ny, nz = (F.col(f"__n{a}") for a in AXES)
    held = voxels.join(about, "case_id").withColumn("__ask", F.coalesce(query, F.lit(False))).withColumn("__d", F.when(F.coalesce(mask, F.lit(False)), F.lit(0.0)))
    largest = about.agg(F.max(nx * ny * nz)).first()[0] or 0
    if largest <= GROUP:  # every volume is a group of its own: all axes at once
        held = held.where("__ask or __d is not null") if asked else held
        found = _pass(held.drop(*(f"__n{a}" for a in AXES)), F.lit(0), (2, 1, 0), True)
    else:
        planes, bundle = (F.greatest(F.lit(1), F.floor(F.lit(GROUP) / (n * nz))) for n in (ny, nx))
        flat = _pass(held, F.floor(F.col("x") / planes), (2, 1), False)
        found = _pass(flat.withColumn("__g", F.floor(F.col("y") / bundle)).drop(*(f"__n{a}" for a in AXES)), F.col("__g"), (0,), True)
    rest = [c for c in voxels.columns if c != "distance"]
    found = found.where("__ask") if asked else found
    return found.select(*rest, F.when(F.col("__ask"), F.sqrt("__d")).alias("distance"))
