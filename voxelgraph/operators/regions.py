"""Regions that reach over bricks: components, least spanning forests, growth from seeds, merging.

Each brick does what is exact without its neighbours; what is left are tables of borders and parts, a small share
of the voxels, on which rounds of joins go on. A volume in one brick needs no round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelgraph.operators import bricks
from voxelgraph.operators.bricks import AXES, Brick
from voxelgraph.operators.components import connected_components
from voxelgraph.session import staged

#: Case and place as one number: a place is below 2^32.
PLACES = 1 << 32
NODE = "decimal(38,0)"


def node(place: str | Column) -> Column:
    place = F.col(place) if isinstance(place, str) else place
    return (F.col("case_id").cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(11,0)") + place).cast(NODE)


def _case(n: Column) -> Column:
    return F.floor(n / F.lit(PLACES).cast("decimal(11,0)"))


def _place(n: Column) -> Column:
    """The place in a node's number."""
    return F.pmod(n, F.lit(PLACES).cast("decimal(11,0)")).cast("bigint")


def linked_parts(key: np.ndarray, held: np.ndarray, within: float) -> np.ndarray:
    """The first cell of each cell's component, over faces whose keys differ by ``within`` at most; -1 where not held.

    Runs along z are the nodes, so that there are far fewer of them than cells.
    """
    links = [held[lo] & held[hi] & ((key[lo] == key[hi]) if not within else (np.abs(key[lo] - key[hi]) <= within)) for lo, hi in bricks.faces()]
    start = np.ones(key.shape, bool)
    start[..., 1:] = ~links[2]
    run = (np.cumsum(start.ravel()) - 1).reshape(key.shape)
    first = np.flatnonzero(start.ravel())
    codes = [run[lo][same] * len(first) + run[hi][same] for (lo, hi), same in zip(list(bricks.faces())[:2], links, strict=False)]
    a, b = np.divmod(np.unique(np.concatenate(codes)), len(first))  # pairs as single numbers, which sort faster
    return np.where(held, first[bricks.joined(len(first), a, b)[run.ravel()]].reshape(key.shape), -1)


def components(voxels: DataFrame, key: Column, name: str = "label", within: float = 0, side: int = 0) -> DataFrame:
    """Add the component of voxels whose face neighbours' keys differ by ``within`` at most: least ``lin`` in it + 1.

    0 where the key is null. First inside each brick; parts that meet on bricks' borders are then joined as a graph.
    """

    def work(brick: Brick) -> np.ndarray:
        lin, keys, held = (brick.array(k, empty) for k, empty in ((0, 0), (1, 0), (2, False)))
        first = linked_parts(keys, held, within)
        return np.where(first < 0, 0, lin.ravel()[first] + 1)

    keyed = voxels.withColumn("__key", key)
    inputs = [F.col("lin").cast("bigint"), F.col("__key"), F.col("__key").isNotNull()]
    local = staged(bricks.on_bricks(keyed, inputs, work, "__part bigint", side, halo=False))
    close = F.col("a___key") == F.col("b___key") if not within else F.abs(F.col("a___key") - F.col("b___key")) <= within
    borders = bricks.touching(local.where("__part > 0"), ["__part", "__key"], side).where(close)
    pairs = staged(borders.select("case_id", "a___part", "b___part").distinct())
    if pairs.isEmpty():
        return local.withColumn(name, F.col("__part")).select(*[c for c in voxels.columns if c != name], name)
    found = connected_components(pairs.select(node(F.col("a___part") - 1).alias("src"), node(F.col("b___part") - 1).alias("dst")))
    moved = found.where("node <> component").select(F.col("node").alias("__node"), (_place(F.col("component")) + 1).alias("__to"))
    out = local.join(moved, node(F.col("__part") - 1) == F.col("__node"), "left").withColumn(name, F.coalesce("__to", "__part"))
    return out.select(*[c for c in voxels.columns if c != name], name)


def forest(brick: Brick) -> tuple[np.ndarray, np.ndarray]:
    """``forest_of`` a brick's gradient, marker and place."""
    return forest_of(*(brick.array(k, empty) for k, empty in ((0, np.nan), (1, 0), (2, -1))), brick.voxels())


def forest_of(gradient: np.ndarray, marker: np.ndarray, lin: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least place of each voxel's part, the part's marker or 0) after all unions that one brick can decide.

    Parts without a marker join the part behind their least edge, the halo's edges included; a part whose least
    edge leads out of the brick waits. An edge weighs the larger gradient of its ends; ties go by the ends.
    """
    shape = own.shape
    gradient, marker, lin, own = (a.ravel() for a in (gradient, marker, lin, own))
    cell = np.arange(own.size).reshape(shape)
    a, b = (np.concatenate([cell[s[k]].ravel() for s in bricks.faces()]) for k in (0, 1))
    weight = np.maximum(gradient[a], gradient[b])
    use = ~np.isnan(weight) & (own[a] | own[b])
    a, b, weight = a[use], b[use], weight[use]
    order = np.lexsort((np.maximum(lin[a], lin[b]), np.minimum(lin[a], lin[b]), weight))
    a, b = a[order], b[order]
    rank = np.arange(len(a))
    part, root = np.arange(own.size), np.where(own, marker, 0)
    chooses = own & (root == 0)
    while len(a):
        pa_, pb = part[a], part[b]
        apart = (pa_ != pb) & (chooses[pa_] | chooses[pb])
        a, b, rank, pa_, pb = a[apart], b[apart], rank[apart], pa_[apart], pb[apart]
        least = np.full(own.size, np.iinfo("i8").max)
        for p in (pa_, pb):
            np.minimum.at(least, p[chooses[p]], rank[chooses[p]])
        parent = np.arange(own.size)
        for p, q in ((pa_, pb), (pb, pa_)):
            mine = chooses[p] & (least[p] == rank) & own[q]
            parent[p[mine]] = q[mine]
        both = parent[parent] == np.arange(own.size)
        parent = np.where(both & (np.arange(own.size) < parent), np.arange(own.size), parent)
        if np.array_equal(parent, np.arange(own.size)):
            break
        part = bricks.settled(parent)[part]
    first = np.full(own.size, np.iinfo("i8").max)
    np.minimum.at(first, part[own], lin[own])
    return np.where(own, first[part], -1).reshape(shape), root[part].reshape(shape)


def _cut(brick: Brick):
    """The least edge between each two parts that a later round may use: (part, other part, weight, both ends)."""
    gradient, part, root, lin = (brick.array(k, empty) for k, empty in ((0, np.nan), (1, -1), (2, 0), (3, -1)))
    rows = []
    for own, lo, hi in bricks.upper_faces(brick):
        weight = np.maximum(gradient[lo], gradient[hi])
        able = own & (part[hi] >= 0) & (part[lo] != part[hi]) & ((root[lo] == 0) | (root[hi] == 0)) & ~np.isnan(weight)
        rows.append((part[lo][able], part[hi][able], weight[able], lin[lo][able], lin[hi][able]))
    p, q, w, a, b = (np.concatenate(c) for c in zip(*rows, strict=True))
    p, q = np.minimum(p, q), np.maximum(p, q)
    order = np.lexsort((b, a, w, q, p))
    p, q, w, a, b = (c[order] for c in (p, q, w, a, b))
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    return tuple(c[new] for c in (p, q, w, a, b))


def spanning_forest(voxels: DataFrame, gradient: str, marker: Column, name: str = "label", side: int = 0, max_rounds: int = 60) -> DataFrame:
    """Add the marker (above 0) that each voxel's tree in the least spanning forest is rooted in, 0 for none.

    Bricks join what they can decide alone. Then, in rounds, every part without a marker joins the part behind
    its least edge (the largest gradient of both ends, ties by the ends): one join for the choice, one for the
    components of the choices, one for what is left of the edges.
    """
    marked = voxels.withColumn("__seeded", F.coalesce(marker, F.lit(0)).cast("bigint"))
    inputs = [F.col(gradient).cast("double"), F.col("__seeded"), F.col("lin").cast("bigint")]
    kept = [c for c in voxels.columns if c != name]
    local = staged(bricks.on_bricks(marked, inputs, forest, "__part bigint, __root bigint", side).drop("__seeded"))
    if local.where("__root = 0").isEmpty():
        return local.withColumn(name, F.col("__root")).select(*kept, name)
    cells = [F.col(gradient).cast("double"), F.col("__part"), F.col("__root"), F.col("lin").cast("bigint")]
    cut = bricks.from_bricks(local, cells, _cut, "p bigint, q bigint, w double, a bigint, b bigint", side)
    edges = staged(_least(cut.select(node("p").alias("p"), node("q").alias("q"), F.struct("w", "a", "b").alias("e"))))
    parts = staged(local.groupBy("case_id", "__part").agg(F.max("__root").alias("root")).select(node("__part").alias("part"), "root"))
    state = parts.select("part", F.col("part").alias("now"), "root")
    for _ in range(max_rounds):
        ways = edges.unionByName(edges.select(F.col("q").alias("p"), F.col("p").alias("q"), "e"))
        free = state.where("root = 0").select(F.col("now").alias("p")).distinct()
        choice = ways.join(free, "p", "left_semi").groupBy("p").agg(F.min(F.struct("e", "q")).alias("m")).select(F.col("p").alias("src"), F.col("m.q").alias("dst"))
        choice = staged(choice)
        if choice.isEmpty():
            break
        found = connected_components(choice).select(F.col("node").alias("now"), "component")
        after = state.join(found, "now", "left").withColumn("now", F.coalesce("component", "now")).drop("component")
        roots = after.groupBy("now").agg(F.max("root").alias("root"))
        state = staged(after.drop("root").join(roots, "now").select("part", "now", "root"))
        ends = roots.select("now", "root")
        moved = edges
        for end in ("p", "q"):
            to = found.select(F.col("now").alias(end), F.col("component").alias(f"__{end}"))
            moved = moved.join(to, end, "left").withColumn(end, F.coalesce(f"__{end}", end)).drop(f"__{end}")
        for end in ("p", "q"):
            moved = moved.join(ends.select(F.col("now").alias(end), F.col("root").alias(f"r{end}")), end)
        edges = staged(_least(moved.where("p <> q and (rp = 0 or rq = 0)").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "e")))
    else:
        raise RuntimeError(f"the forest did not settle in {max_rounds} rounds")
    named = state.select(F.col("part").alias("__node"), F.col("root").alias(name))
    out = local.select(*kept, "__part").join(named, node("__part") == F.col("__node"), "left")
    return out.select(*kept, F.coalesce(name, F.lit(0)).alias(name))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("p", "q").agg(F.min("e").alias("e"))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash64(*columns: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of whole numbers."""
    turn = lambda a, n: (a << np.uint64(n)) | (a >> np.uint64(64 - n))
    out = np.full(len(columns[0]), 42, "u8")
    with np.errstate(over="ignore"):
        for c in columns:
            h = (out + _P5 + np.uint64(8)) ^ (turn(c.astype("i8").view("u8") * _P2, 31) * _P1)
            h = turn(h, 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out = h ^ (h >> np.uint64(32))
    return out.view("i8")


def merged_within(names: np.ndarray, n: np.ndarray, total: np.ndarray, lo: np.ndarray, hi: np.ndarray, alpha: float, most: int, max_rounds: int = 101) -> np.ndarray:
    """``merged`` for the regions of one case: the new label of each. ``names`` ascend; ``lo, hi`` are rows of them."""
    now = np.arange(len(names))  # a region's row is that of its least label, so rows order as labels
    n, total = n.copy(), total.astype("f8")
    for _ in range(max_rounds):
        with np.errstate(invalid="ignore", divide="ignore"):
            gap = np.abs(total[lo] / n[lo] - total[hi] / n[hi])
        able = (gap <= alpha) & (n[lo] + n[hi] <= most)
        if not able.any():
            break
        a, b = lo[able], hi[able]
        order = np.lexsort((b, a, xxhash64(names[a], names[b]), gap[able]))
        a, b = a[order], b[order]
        # the first edge of each region, in the order of edges
        ends, edge = np.stack([a, b], 1).ravel(), np.repeat(np.arange(len(a)), 2)
        own, first = np.unique(ends, return_index=True)
        e = edge[first]
        to = np.where(a[e] == own, b[e], a[e])
        chosen = np.full(len(names), -1)
        chosen[own] = e
        both = chosen[to] == e
        takes = np.where((n[own] > n[to]) | ((n[own] == n[to]) & (own < to)), own, to)
        hub = np.zeros(len(names), bool)
        hub[takes[both]] = True
        rows = np.flatnonzero(hub[to])
        rows = rows[np.lexsort((e[rows], to[rows]))]
        own, to = own[rows], to[rows]
        new = np.ones(len(rows), bool)
        new[1:] = to[1:] != to[:-1]
        joins, size, extra, open_ = np.zeros(len(rows), bool), 0, 0.0, False
        for k, (o, t, begins) in enumerate(zip(own.tolist(), to.tolist(), new.tolist(), strict=True)):
            if begins:
                size, extra, open_ = int(n[t]), 0.0, True
            if not open_:
                continue
            open_ = size + n[o] <= most and (begins or abs((total[t] + extra) / size - total[o] / n[o]) <= alpha)
            if open_:
                joins[k], size, extra = True, size + int(n[o]), extra + total[o]
        own, to = own[joins], to[joins]
        if not len(own):
            break
        least = np.arange(len(names))
        np.minimum.at(least, to, own)  # of a hub and of all it takes
        move = np.arange(len(names))
        move[own], move[to] = least[to], least[to]
        gone = np.flatnonzero(move != np.arange(len(names)))
        np.add.at(n, move[gone], n[gone])
        np.add.at(total, move[gone], total[gone])
        n[gone], total[gone] = 0, 0.0
        now = move[now]
        lo, hi = move[lo], move[hi]
        apart = lo != hi
        lo, hi = np.minimum(lo, hi)[apart], np.maximum(lo, hi)[apart]
        lo, hi = np.divmod(np.unique(lo * len(names) + hi), len(names))
    return names[now]


def merged(regions: DataFrame, edges: DataFrame, alpha: float, most: int, max_rounds: int = 101) -> DataFrame:
    """``(case_id, label, merged)``: regions (``case_id, label, n, total``) after merging over ``edges`` (``case_id, lo, hi``).

    In a round every region chooses the neighbour with the closest mean among those within ``alpha`` with whom it
    has at most ``most`` voxels. Of two that choose each other the larger one takes in, closest first, those that
    chose it, as long as each is within ``alpha`` of the mean it has by then and fits: running sums, so every
    merger is admissible when it happens. The closest pair of all always chooses each other, so every round merges
    until no admissible pair is left (or ``max_rounds`` are over). Equal gaps go by a hash of both labels. A merged
    region has the least of its labels.
    """
    now = staged(regions.select("case_id", F.col("label").alias("merged"), "n", F.col("total").cast("double").alias("total")))
    names = regions.select("case_id", "label", F.col("label").alias("merged"))
    links = staged(edges.select("case_id", "lo", "hi"))
    for _ in range(max_rounds):
        a, b = (now.select("case_id", F.col("merged").alias(end), F.col("n").alias(f"n_{end}"), F.col("total").alias(f"t_{end}")) for end in ("lo", "hi"))
        gap = F.abs(F.col("t_lo") / F.col("n_lo") - F.col("t_hi") / F.col("n_hi"))
        able = links.join(a, ["case_id", "lo"]).join(b, ["case_id", "hi"]).withColumn("gap", gap).where((F.col("gap") <= alpha) & (F.col("n_lo") + F.col("n_hi") <= most))
        row = lambda end: F.struct(*(F.col(f"{c}_{end}").alias(c) for c in "nt"))
        way = lambda own, to: F.struct(F.col(own).alias("own"), F.col(to).alias("to"), row(own).alias("mine"), row(to).alias("its"))
        ways = able.select("case_id", F.struct("gap", F.xxhash64("lo", "hi").alias("tie"), "lo", "hi").alias("e"), F.explode(F.array(way("lo", "hi"), way("hi", "lo"))).alias("w"))
        best = staged(ways.groupBy("case_id", F.col("w.own").alias("own")).agg(F.min_by(F.struct("e", "w.to", "w.mine", "w.its"), "e").alias("b")).select("case_id", "own", "b.*"))
        # an edge that both its ends chose makes the larger one take in
        takes = F.when((F.col("mine.n") > F.col("its.n")) | ((F.col("mine.n") == F.col("its.n")) & (F.col("own") < F.col("to"))), F.col("own")).otherwise(F.col("to"))
        hubs = best.groupBy("case_id", "e").agg(F.count("*").alias("k"), F.min(takes).alias("to")).where("k = 2").select("case_id", "to")
        taken = best.join(hubs, ["case_id", "to"], "left_semi")
        before = Window.partitionBy("case_id", "to").orderBy("e").rowsBetween(Window.unboundedPreceding, -1)
        upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        size, total = (F.col(f"its.{c}") + F.coalesce(F.sum(f"mine.{c}").over(before), F.lit(0)) for c in "nt")
        fits = (size + F.col("mine.n") <= most) & ((F.abs(total / size - F.col("mine.t") / F.col("mine.n")) <= alpha) | F.col("first"))
        chain = taken.withColumn("first", F.row_number().over(Window.partitionBy("case_id", "to").orderBy("e")) == 1).withColumn("fits", fits)
        joins = staged(chain.withColumn("all", F.min("fits").over(upto)).where("all").select("case_id", F.col("own").alias("merged"), F.col("to").alias("__to")))
        if joins.isEmpty():
            break
        # the least label of a hub and of all it takes
        least = joins.groupBy("case_id", "__to").agg(F.least(F.min("merged"), F.col("__to")).alias("name"))
        whole = joins.join(least, ["case_id", "__to"])
        moves = staged(whole.select("case_id", "merged", F.col("name").alias("__to")).unionByName(least.select("case_id", F.col("__to").alias("merged"), F.col("name").alias("__to"))).where("merged <> __to"))

        def moved(df: DataFrame, column: str, moves: DataFrame = moves) -> DataFrame:
            return df.join(moves.withColumnRenamed("merged", column), ["case_id", column], "left").withColumn(column, F.coalesce("__to", column)).drop("__to")

        names = staged(moved(names, "merged"))
        now = staged(moved(now, "merged").groupBy("case_id", "merged").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
        both = moved(moved(links, "lo"), "hi").where("lo <> hi")
        links = staged(both.select("case_id", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct())
    return names.select("case_id", "label", "merged")
