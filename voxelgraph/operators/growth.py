"""Regions grown from seeds in a fixed order, each within a tolerance of its seed's value.

Seeds are taken in order among the voxels that are left, so a region depends on the earlier ones; but two
neighbours in a region differ by twice the tolerance at most, hence components of such neighbours (groups) never
touch each other's regions. Growth goes in waves: in each, the first seed of every group takes its region. Groups of
up to ``SMALL`` voxels are dealt to tasks, many together, and all their waves run there. Larger ones go wave by
wave as tables, where what is left falls apart into new groups, until all are small.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelgraph.operators import regions
from voxelgraph.operators.bricks import AXES
from voxelgraph.session import ship, staged

#: Voxels of a group that a task may hold, and voxels of small groups that are dealt to a task together.
SMALL, TOGETHER = 1 << 20, 1 << 18
#: Along each axis seeds start at this part of its length and go on by the first stride from this share on.
STARTS, STRIDE = {"x": 3, "y": 5, "z": 7}, 2.236
#: Fixed order of a voxel's face neighbours, as (axis, step).
WAYS = [(a, d) for a in AXES for d in (-1, 1)]


def stride(n: int) -> int:
    """The first number from n / 2.236 on without a factor of n, else the last one before it."""
    start = max(1, int(n / STRIDE))
    return min((s for s in range(1, n) if gcd(s, n) == 1), key=lambda s: (s < start, abs(s - start)), default=1)


def reach(tolerance: float) -> float:
    """Never less than what two voxels of a region can differ by."""
    return 2 * tolerance * (1 + 1e-9) + 1e-12


def with_priority(voxels: DataFrame, held: Column | None = None) -> DataFrame:
    """Add ``__priority``: a voxel's place in the order in which voxels become seeds of their case.

    held: the voxels that tell the case's extent; a case without any has a null place.
    """
    spark = voxels.sparkSession
    dims = staged((voxels if held is None else voxels.where(held)).groupBy("case_id").agg(*((F.max(a) + 1).alias(f"__n{a}") for a in AXES)))
    lengths = [r[0] for r in dims.select(F.explode(F.array(*(f"__n{a}" for a in AXES)))).distinct().collect()]  # lengths of axes: some hundreds
    turns = spark.createDataFrame([(n, pow(stride(n), -1, n)) for n in lengths] or [(0, 0)], "n int, back int")
    for a in AXES:
        dims = dims.join(F.broadcast(turns.select(F.col("n").alias(f"__n{a}"), F.col("back").cast("bigint").alias(f"__b{a}"))), f"__n{a}")
    turn = {a: F.expr(f"pmod(({a} - __n{a} div {STARTS[a]}) * __b{a}, __n{a})") for a in AXES}
    place = (turn["x"] * F.col("__ny") + turn["y"]) * F.col("__nz") + turn["z"]
    return voxels.join(dims, "case_id", "inner" if held is None else "left").withColumn("__priority", place.cast("bigint")).drop(*(f"__{k}{a}" for a in AXES for k in "nb"))


def seed_order(at: list[np.ndarray]) -> np.ndarray:
    """Rows by their ``with_priority``, for all voxels of one case that tell its extent."""
    keys = []
    for a, c in zip(AXES, at, strict=True):
        n = int(c.max()) + 1
        keys.append((c.astype("i8") - n // STARTS[a]) * pow(stride(n), -1, n) % n)
    return np.lexsort(keys[::-1])


def by_queue(value: np.ndarray, held: np.ndarray, seeds: np.ndarray, tolerance: float, most: int | None) -> np.ndarray:
    """The cell of the seed of each cell's region, -1 where not held; both arrays have a frame of cells that aren't held.

    The definition itself, one step for each face of a voxel: for a volume of one brick this is less than waves, which
    take some dozen array operations for each layer of each region.
    """
    steps = [d * s for s in (held.shape[1] * held.shape[2], held.shape[2], 1) for d in (-1, 1)]  # as in WAYS
    v, owner, room = value.ravel().tolist(), np.where(held, -1, -2).ravel().tolist(), held.size if most is None else most
    for seed in seeds.tolist():
        if owner[seed] != -1:
            continue
        at, region, owner[seed] = v[seed], [seed], seed
        for cell in region:  # which grows meanwhile
            if len(region) >= room:
                break
            for step in steps:
                near = cell + step
                if owner[near] == -1 and abs(v[near] - at) <= tolerance:
                    owner[near] = seed
                    region.append(near)
                    if len(region) >= room:
                        break
    return np.maximum(np.array(owner), -1).reshape(held.shape)


def in_waves(at: list[np.ndarray], value: np.ndarray, group: np.ndarray, priority: np.ndarray, tolerance: float, most: int | None) -> np.ndarray:
    """The row of the seed of each row's region; all groups grow at once, a seed of each in a wave, layer by layer."""
    n = len(value)
    sizes = [int(a.max()) + 3 for a in at]
    code = ((at[0].astype("i8") + 1) * sizes[1] + at[1] + 1) * sizes[2] + at[2] + 1
    order = np.argsort(code)
    ordered = code[order]
    beside = np.empty((n, len(WAYS)), "i8")
    for k, (axis, step) in enumerate(WAYS):
        there = code + step * {"x": sizes[1] * sizes[2], "y": sizes[2], "z": 1}[axis]
        found = np.minimum(np.searchsorted(ordered, there), n - 1)
        beside[:, k] = np.where(ordered[found] == there, order[found], -1)
    _, group = np.unique(group, return_inverse=True)
    owner, left = np.full(n, -1), np.lexsort((priority, group))
    while len(left):
        new = np.ones(len(left), bool)
        new[1:] = group[left[1:]] != group[left[:-1]]
        front = left[new]
        seeds, own, size = front, np.arange(len(front)), np.ones(len(front), "i8")
        owner[front] = front
        while len(front):
            near = beside[front].ravel()
            whose = np.repeat(own, len(WAYS))
            able = near >= 0
            near, whose = near[able], whose[able]
            able = (owner[near] < 0) & (group[near] == group[seeds[whose]]) & (np.abs(value[near] - value[seeds[whose]]) <= tolerance)
            near, whose = near[able], whose[able]
            _, first = np.unique(near, return_index=True)
            first.sort()  # in the order of a queue: by parent, then by direction
            front, own = near[first], whose[first]
            if most is not None and len(front):
                begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                rank = np.arange(len(own)) - np.repeat(begins, np.diff(begins, append=len(own)))
                fits = rank < most - size[own]
                front, own = front[fits], own[fits]
            owner[front] = seeds[own]
            size += np.bincount(own, minlength=len(size))
        left = left[owner[left] < 0]
    return owner


def _small(held: DataFrame, tolerance: float, most: int | None) -> DataFrame:
    """``(case_id, lin, seed)`` for voxels of groups that fit a task; ``held`` has ``__group, __priority, __v``."""
    ship(held.sparkSession, numbers=True)
    counts = held.groupBy("case_id").agg(F.count("*").alias("__n"))
    shares = F.pmod(F.xxhash64("__group"), 1 + F.expr(f"__n div {TOGETHER}"))
    dealt = held.select("case_id", *AXES, "lin", "__v", "__group", "__priority").join(counts, "case_id").withColumn("__share", shares).drop("__n")
    kind = held.schema["case_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        at, (v, group, priority, lin) = [table.column(a).to_numpy() for a in AXES], (table.column(c).to_numpy() for c in ("__v", "__group", "__priority", "lin"))
        return pa.table([table.column("case_id"), pa.array(lin, pa.int64()), pa.array(lin[in_waves(at, v, group, priority, tolerance, most)], pa.int64())], names=["case_id", "lin", "seed"])

    return dealt.groupBy("case_id", "__share").applyInArrow(run, f"case_id {kind}, lin bigint, seed bigint")


def _capped(region: DataFrame, most: int) -> DataFrame:
    """The first ``most`` voxels of each region in breadth-first order from its seed; layer after layer by joins.

    ``region``: ``case_id, __group, x, y, z, lin, seed``. The last layer that fits in part is cut by its rank: by
    parent, then by direction.
    """
    key = ["case_id", "__group"]
    front = region.where("lin = seed").withColumn("rank", F.lit(0).cast("bigint"))
    taken, size = front, region.where("lin = seed").select(*key, F.lit(1).cast("bigint").alias("size"))
    ways = F.array(*(F.struct(F.lit(k).alias("k"), *(((F.lit(d) if b == a else F.lit(0))).alias(f"d{b}") for b in AXES)) for k, (a, d) in enumerate(WAYS)))
    while True:
        step = front.withColumn("w", F.explode(ways)).select(*key, *((F.col(a) + F.col(f"w.d{a}")).alias(a) for a in AXES), (F.col("rank") * len(WAYS) + F.col("w.k")).alias("turn"))
        near = step.groupBy(*key, *AXES).agg(F.min("turn").alias("turn"))
        fresh = region.join(near, [*key, *AXES]).join(taken.select("case_id", "lin"), ["case_id", "lin"], "left_anti")
        ranked = fresh.join(size, key).withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("turn")).cast("bigint") - 1)
        front = staged(ranked.where(F.col("rank") < most - F.col("size")).select(*region.columns, "rank"))  # a layer of a region of at most ``most``
        if front.isEmpty():
            return taken.drop("rank")
        taken = staged(taken.select(*region.columns, "rank").unionByName(front))
        size = staged(taken.groupBy(*key).agg(F.count("*").alias("size")))


def grown(voxels: DataFrame, value: str, tolerance: float, most: int | None = None, small: int = SMALL, side: int = 0) -> tuple[DataFrame, int]:
    """(``voxels`` with ``seed``, the ``lin`` of its region's seed, null without a value; waves that ran as tables)."""
    held = with_priority(voxels.where(F.col(value).isNotNull() & ~F.isnan(value)).select("case_id", *AXES, F.col("lin").cast("bigint").alias("lin"), F.col(value).cast("double").alias("__v")))
    def grouped(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows in groups that fit a task, rows in larger ones)"""
        df = staged(regions.components(df, F.col("__v"), "__group", reach(tolerance), side))
        large = staged(df.groupBy("case_id", "__group").count().where(F.col("count") > small).select("case_id", "__group"))
        if large.isEmpty():
            return df, df.limit(0)
        # at most one row for each ``small`` voxels
        return df.join(F.broadcast(large), ["case_id", "__group"], "left_anti"), df.join(F.broadcast(large), ["case_id", "__group"], "left_semi")

    fits, rest = grouped(held)
    done, waves = _small(fits, tolerance, most), 0
    while not rest.isEmpty():
        waves += 1
        seeds = staged(rest.groupBy("case_id", "__group").agg(F.min(F.struct("__priority", "lin", "__v")).alias("s")).select("case_id", "__group", F.col("s.lin").alias("seed"), F.col("s.__v").alias("__s")))
        near = rest.join(F.broadcast(seeds), ["case_id", "__group"]).where(F.abs(F.col("__v") - F.col("__s")) <= tolerance)  # a row for each large group
        parts = staged(regions.components(near, F.col("__group"), "__part", 0, side))
        first = staged(parts.where("lin = seed").select("case_id", "__group", "__part"))
        region = parts.join(F.broadcast(first), ["case_id", "__group", "__part"], "left_semi").select("case_id", "__group", *AXES, "lin", "seed")  # a row for each large group
        if most is not None:
            over = staged(region.groupBy("case_id", "__group").count().where(F.col("count") > most).select("case_id", "__group"))
            if not over.isEmpty():
                region = region.join(over, ["case_id", "__group"], "left_anti").unionByName(_capped(staged(region.join(over, ["case_id", "__group"], "left_semi")), most))
        region = staged(region.select("case_id", "lin", "seed"))
        fits, rest = grouped(rest.drop("__group").join(region, ["case_id", "lin"], "left_anti"))
        done = done.unionByName(region).unionByName(_small(fits, tolerance, most))
    return voxels.join(done, ["case_id", "lin"], "left"), waves
