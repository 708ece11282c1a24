"""Volumes in bricks: cubes of ``SIDE`` voxels, each worked on with a halo of one voxel of its neighbours.

A brick is what a task holds (some 40,000 voxels with its halo, a few MB), however large the volume. One shuffle
deals voxels to bricks; those on a brick's border also go, as halo, to the up to seven bricks that they touch. What
reaches farther than one voxel (components, forests, growth) is solved inside bricks as far as that is exact, and
the rest goes on as tables of borders and regions, by joins.

Voxels that a table lacks are outside the volume.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, NumericType, StructField, StructType

from voxelgraph.session import ship

AXES = ("x", "y", "z")
#: Voxels along a brick's edge.
SIDE = 32
#: A brick's place along each axis is below 2^``PLACE``.
PLACE = 20

Shape = tuple[int, int, int]


class Brick:
    """One brick's arrays with a frame of one voxel on every side, which holds the halo or is outside."""

    def __init__(self, table: pa.Table, inputs: list[str], side: int):
        at = [table.column(a).to_numpy() for a in AXES]
        self.own = table.column("__own").to_numpy() if "__own" in table.column_names else np.ones(table.num_rows, bool)
        self.first = first = [int(a[self.own][0]) // side * side - 1 for a in at]
        self.shape: Shape = tuple(int(a[self.own].max()) - f + 2 for a, f in zip(at, first, strict=True))
        inside = np.ones(len(self.own), bool)
        for a, f, n in zip(at, first, self.shape, strict=True):
            inside &= a - f < n
        self.place = ((at[0] - first[0]).astype("i8") * self.shape[1] + at[1] - first[1]) * self.shape[2] + at[2] - first[2]
        self._inside, self._table, self.inputs = inside, table, inputs

    def array(self, k: int, empty) -> np.ndarray:
        """The k-th input, ``empty`` where there is no voxel or the input is null."""
        column = self._table.column(self.inputs[k])
        return self._framed(column.fill_null(empty).to_numpy() if column.null_count else column.to_numpy(), empty)

    def valid(self, k: int) -> np.ndarray:
        """Which cells have a voxel whose k-th input isn't null."""
        return self._framed(self._table.column(self.inputs[k]).is_valid().to_numpy(), False)

    def _framed(self, values: np.ndarray, empty) -> np.ndarray:
        out = np.full(self.shape[0] * self.shape[1] * self.shape[2], empty, values.dtype)
        out[self.place[self._inside]] = values[self._inside]
        return out.reshape(self.shape)

    def voxels(self) -> np.ndarray:
        """Which cells are voxels of the brick itself."""
        out = np.zeros(self.shape[0] * self.shape[1] * self.shape[2], bool)
        out[self.place[self.own]] = True
        return out.reshape(self.shape)


def placed(side: int) -> Column:
    """A number for the brick of a voxel."""
    x, y, z = (F.expr(f"cast({a} div {side} as bigint)") for a in AXES)
    return F.shiftleft(F.shiftleft(x, PLACE) + y, PLACE) + z


def _dealt(voxels: DataFrame, side: int, halo: bool) -> DataFrame:
    """``voxels`` with ``__brick``; with a halo border voxels once more for each brick that they touch, and ``__own``."""
    if not halo:
        return voxels.withColumn("__brick", placed(side))
    # the 27 steps to a neighbour as 0..26, 13 being the brick itself; which of them by two bits for each axis: at its lower, upper border
    bits = " + ".join(f"case when {a} > 0 and {a} % {side} = 0 then {1 << 2 * n} else 0 end + case when {a} % {side} = {side - 1} then {2 << 2 * n} else 0 end" for n, a in enumerate(AXES))
    able = lambda code, n, step: step == 1 or code >> 2 * n & (1 if step == 0 else 2)
    of = [[k for k in range(27) if able(code, 0, k // 9) and able(code, 1, k // 3 % 3) and able(code, 2, k % 3)] for code in range(64)]
    steps = F.expr(f"array({', '.join(f'array({", ".join(map(str, ks))})' for ks in of)})[{bits}]")
    moved = F.expr(f"shiftleft(shiftleft(cast(__k div 9 - 1 as bigint), {PLACE}) + __k div 3 % 3 - 1, {PLACE}) + __k % 3 - 1")
    return voxels.withColumn("__k", F.explode(steps)).withColumn("__brick", placed(side) + moved).withColumn("__own", F.col("__k") == 13).drop("__k")


def _grouped(voxels: DataFrame, kept: list[str], inputs: list[Column | str], side: int, halo: bool):
    more = [c if isinstance(c, str) else c.alias(f"__{k}") for k, c in enumerate(inputs) if not isinstance(c, str) or c not in kept]
    held = voxels.select(*kept, *more)
    ship(voxels.sparkSession, numbers=all(isinstance(f.dataType, (NumericType, BooleanType)) for f in held.schema))
    return _dealt(held, side, halo).groupBy("case_id", "__brick")


def _named(inputs: list[Column | str]) -> list[str]:
    return [c if isinstance(c, str) else f"__{k}" for k, c in enumerate(inputs)]


def on_bricks(voxels: DataFrame, inputs: list[Column | str], work: Callable, outputs: str, side: int = 0, halo: bool = True) -> DataFrame:
    """``voxels`` with the columns ``outputs`` (a schema) that ``work(brick)`` returns as arrays of the brick's shape.

    A column of the same name is replaced; NaN is null. An input that is a name is that column as it is, which crosses once.
    """
    side = side or SIDE
    added = StructType.fromDDL(outputs)
    names = [c for c in voxels.columns if c not in added.names]
    schema = StructType([voxels.schema[c] for c in names] + [StructField(f.name, f.dataType) for f in added])
    n, new = _named(inputs), [pa.field(f.name, to_arrow_type(f.dataType)) for f in added]

    def fields(table: pa.Table) -> list[pa.Field]:
        return [table.schema.field(c) for c in names] + new

    def run(table: pa.Table) -> pa.Table:
        if halo and not table.column("__own").to_numpy().any():  # halo of a brick that the volume doesn't have
            return pa.table({f.name: pa.array([], f.type) for f in fields(table)})
        brick = Brick(table, n, side)
        found = work(brick)
        out = table.select(names).filter(pa.array(brick.own)) if halo else table.select(names)
        place = brick.place[brick.own]
        for f, values in zip(added, found if isinstance(found, tuple) else (found,), strict=True):
            out = out.append_column(f.name, pa.array(values.ravel()[place], from_pandas=True))
        return out

    return _grouped(voxels, voxels.columns, inputs, side, halo).applyInArrow(run, schema)


def from_bricks(voxels: DataFrame, inputs: list[Column | str], work: Callable, outputs: str, side: int = 0, halo: bool = True) -> DataFrame:
    """``(case_id, *outputs)``: the rows that ``work(brick)`` returns, as a list of arrays, for each brick with its halo."""
    side = side or SIDE
    kind = voxels.schema["case_id"].dataType.simpleString()
    added, n = StructType.fromDDL(outputs), _named(inputs)
    types = [to_arrow_type(f.dataType) for f in added]

    def run(table: pa.Table) -> pa.Table:
        found = work(Brick(table, n, side)) if not halo or table.column("__own").to_numpy().any() else [[] for _ in types]
        columns = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(found, types, strict=True)]
        case = table.column("case_id")
        return pa.table([pa.repeat(case[0], len(columns[0])), *columns], names=["case_id", *added.names])

    return _grouped(voxels, ["case_id", *AXES], inputs, side, halo).applyInArrow(run, f"case_id {kind}, {outputs}")


def faces() -> Iterator[tuple[tuple, tuple]]:
    """For each axis the slices of all cells but the last and all but the first."""
    whole = (slice(None),) * 3
    for k in range(3):
        yield whole[:k] + (slice(0, -1),) + whole[k + 1 :], whole[:k] + (slice(1, None),) + whole[k + 1 :]


def upper_faces(brick: Brick) -> Iterator[tuple[np.ndarray, tuple, tuple]]:
    """As ``faces``, with which lower cells are the brick's own: among those each face of a volume is seen once."""
    own = brick.voxels()
    for lo, hi in faces():
        yield own[lo], lo, hi


def touching(rows: DataFrame, columns: list[str], side: int = 0) -> DataFrame:
    """``(case_id, *columns of the lower end as a_, *of the upper end as b_)`` for face neighbours in different bricks.

    Only the voxels on the bricks' borders are joined.
    """
    side = side or SIDE
    lower = F.expr("filter(array(" + ", ".join(f"case when {a} % {side} = {side - 1} then {k} end" for k, a in enumerate(AXES)) + "), k -> k is not null)")
    upper = F.expr("filter(array(" + ", ".join(f"case when {a} > 0 and {a} % {side} = 0 then {k} end" for k, a in enumerate(AXES)) + "), k -> k is not null)")
    step = [(F.col(a) + (F.col("__axis") == k).cast("int")).alias(a) for k, a in enumerate(AXES)]
    a = rows.where(" or ".join(f"{a} % {side} = {side - 1}" for a in AXES)).withColumn("__axis", F.explode(lower)).select("case_id", "__axis", *step, *(F.col(c).alias(f"a_{c}") for c in columns))
    b = rows.where(" or ".join(f"({a} > 0 and {a} % {side} = 0)" for a in AXES)).withColumn("__axis", F.explode(upper)).select("case_id", "__axis", *AXES, *(F.col(c).alias(f"b_{c}") for c in columns))
    return a.join(b, ["case_id", "__axis", *AXES]).drop("__axis", *AXES)


def surface(*masks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells of each mask with a face neighbour outside it."""
    out = []
    for m in masks:
        inner = m.copy()
        for lo, hi in faces():
            inner[lo] &= m[hi]
            inner[hi] &= m[lo]
        out.append(m & ~inner)
    return tuple(out)


def label_surface(label: np.ndarray) -> np.ndarray:
    """Cells with a face neighbour of another label."""
    out = np.zeros(label.shape, bool)
    for lo, hi in faces():
        differs = label[lo] != label[hi]
        out[lo] |= differs
        out[hi] |= differs
    return out


def sobel(value: np.ndarray) -> np.ndarray:
    """Magnitude of the 3-D gradient; a missing neighbour counts as the cell itself."""
    slices = list(faces())

    def near(a: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = slices[axis]
        before, after = a.copy(), a.copy()
        before[hi], after[lo] = a[lo], a[hi]
        return np.where(np.isnan(before), a, before), np.where(np.isnan(after), a, after)

    smooth, sides = value, []
    for axis in range(3):
        blurred = []
        for a in (smooth, *sides):
            before, after = near(a, axis)
            blurred.append((before + 2.0 * a + after) / 4.0)
        before, after = near(smooth, axis)
        smooth, sides = blurred[0], [*blurred[1:], (after - before) / 2.0]
    return np.sqrt((sides[0] * sides[0] + sides[1] * sides[1] + sides[2] * sides[2]) / 3.0)


def settled(parent: np.ndarray) -> np.ndarray:
    """Every node's root, by pointer jumping."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node reachable from each of n nodes over the links a - b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        up = root.copy()
        np.minimum.at(up, root[a], low)
        np.minimum.at(up, root[b], low)
        root = settled(up)
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def face_pairs(brick: Brick, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, faces) for each pair of adjacent labels above 0, of the faces that are the brick's own."""
    found = []
    for own, lo, hi in upper_faces(brick):
        differs = own & (label[lo] != label[hi]) & (label[lo] > 0) & (label[hi] > 0)
        found.append(np.stack([np.minimum(label[lo], label[hi])[differs], np.maximum(label[lo], label[hi])[differs]]))
    lo, hi = np.concatenate(found, axis=1)
    names, place = np.unique(np.concatenate([lo, hi]), return_inverse=True)  # pairs as single numbers, which sort faster
    codes, n = np.unique(place[: len(lo)] * len(names) + place[len(lo) :], return_counts=True)
    return names[codes // max(1, len(names))], names[codes % max(1, len(names))], n


def face_counts(labelled: DataFrame, side: int = 0) -> DataFrame:
    """``(case_id, lo, hi, shared_faces)`` for each pair of adjacent labels above 0; bricks count, sums are shuffled."""
    parts = from_bricks(labelled, [F.col("label").cast("bigint")], lambda brick: face_pairs(brick, brick.array(0, 0)), "lo bigint, hi bigint, n bigint", side)
    return parts.groupBy("case_id", "lo", "hi").agg(F.sum("n").alias("shared_faces"))


def faces_and_means(labelled: DataFrame, value: Column, side: int = 0) -> DataFrame:
    """``(case_id, lo, hi, n, mean)``: faces of each pair of adjacent labels as ``n``, each label with itself by its mean.

    Voxels cross once for both; a label's mean is over its values that aren't null.
    """

    def work(brick: Brick):
        label = brick.array(0, 0)
        lo, hi, n = face_pairs(brick, label)
        held = brick.voxels() & (label > 0)
        some = brick.valid(1)[held]
        names, of = np.unique(label[held], return_inverse=True)
        count = np.bincount(of, some, len(names)).astype("i8")
        total = np.bincount(of, np.where(some, brick.array(1, np.nan)[held], 0.0), len(names))
        return [np.concatenate(c) for c in ((lo, names), (hi, names), (n, count), (np.zeros(len(lo)), total))]

    parts = from_bricks(labelled, [F.col("label").cast("bigint"), value.cast("double")], work, "lo bigint, hi bigint, n bigint, total double", side)
    sums = parts.groupBy("case_id", "lo", "hi").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.select("case_id", "lo", "hi", "n", F.when(F.col("lo") == F.col("hi"), F.col("total") / F.nullif("n", F.lit(0))).alias("mean"))
