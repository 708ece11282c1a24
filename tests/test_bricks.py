"""Volumes that reach over several bricks, against whole-volume versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contract import arrays, flood, kruskal, seeds_by_hand, table

from voxelgraph.operators import bricks, contract, distance, evaluate, features, growth, regions, stencil
from voxelgraph import session
from voxelgraph.operators import edges as E


@pytest.fixture(autouse=True)
def small_bricks(monkeypatch):
    """Bricks of three voxels, so that these volumes have many."""
    monkeypatch.setattr(bricks, "SIDE", 3)


def column(df, name, shape):
    out = np.zeros(shape)
    for r in df.select("lin", name).collect():
        out.ravel()[r[0]] = np.nan if r[1] is None else r[1]
    return out


def test_surfaces_and_gradient_equal_those_of_one_brick(spark, monkeypatch):
    rng = np.random.default_rng(1)
    a = [rng.random((7, 5, 10)), rng.random((3, 3, 3)), rng.random((1, 8, 2))]
    df, _ = table(spark, *a)
    df = df.where("case_id > 0 or lin % 11 <> 3")  # missing voxels are outside

    def found():
        s = stencil.gradient_magnitude(stencil.with_surfaces(df, {"m": F.col("v") > 0.4, "k": F.col("v") < 0.9}), "v")
        own = features.bricks.on_bricks(s, [(F.col("v") * 3).cast("long")], lambda b: bricks.label_surface(b.array(0, -1)), "own boolean")
        return {(r.case_id, r.lin): (r.m, r.k, r.own, round(r.gradient, 12)) for r in own.collect()}

    many = found()
    monkeypatch.setattr(bricks, "SIDE", 32)
    assert many == found()
    assert len(many) == df.count()


def test_face_counts_by_hand(spark):
    rng = np.random.default_rng(2)
    label = rng.integers(0, 5, (7, 6, 8))
    df, _ = table(spark, label.astype(float))
    got = {(r.lo, r.hi): r.shared_faces for r in E.shared_faces(df.withColumn("label", F.col("v").cast("long"))).collect()}
    want = {}
    for k in range(3):
        for p, q in zip(np.moveaxis(label, k, 0)[:-1].ravel(), np.moveaxis(label, k, 0)[1:].ravel()):
            if p != q and p and q:
                want[min(p, q), max(p, q)] = want.get((min(p, q), max(p, q)), 0) + 1
    assert got == want


def test_components_across_bricks_against_flood_fill(spark):
    rng = np.random.default_rng(3)
    snake = np.zeros((9, 9, 9))
    snake[::2, :, ::2] = 1
    snake[1::2, 0, ::2] = 1
    a = [rng.integers(0, 2, (8, 7, 10)).astype(float), np.ones((10, 4, 4)), snake, rng.integers(0, 3, (2, 2, 2)).astype(float)]
    df, _ = table(spark, *a)
    got = arrays(contract.connected(df, F.col("v")), [x.shape for x in a])
    assert all((g == flood(x)).all() for g, x in zip(got, a))
    held = contract.connected(df, F.when(F.col("v") == 1, F.lit(1)))
    assert held.where("label = 0").count() == sum(int((x != 1).sum()) for x in a)
    assert all(((g == flood(x)) | (x != 1)).all() for g, x in zip(arrays(held, [x.shape for x in a]), a))


def test_forest_across_bricks_against_kruskal(spark):
    """Different weights, ties, one marker, none, and a part that no marker reaches, as five cases of one table."""
    rng = np.random.default_rng(4)
    shape = (7, 7, 5)
    some = {3: 1, 60: 2, 119: 3, 200: 4, 201: 5}
    tied = rng.integers(0, 4, shape) / 4.0
    cases = [(rng.permutation(7 * 7 * 5).reshape(shape) / 10.0, some), (tied, some), (tied, {0: 7}), (tied, {}), (rng.random(shape), {2: 9})]
    df, _ = table(spark, *(g for g, _ in cases))
    df = df.where("case_id < 4 or x <> 3")  # the last one is in two halves
    m = spark.createDataFrame([(c, k, v) for c, (_, markers) in enumerate(cases) for k, v in markers.items()], "case_id long, lin long, marker long")
    got = arrays(contract.marker_watershed(df, "v", m), [shape] * 5)
    assert all((got[c] == kruskal(g, markers)).all() for c, (g, markers) in enumerate(cases[:4])) and (got[3] == 0).all()
    assert (got[4][:3] == 9).all() and (got[4][3:] == 0).all()


@pytest.mark.parametrize(("most", "small"), [(None, 1 << 20), (7, 1 << 20), (40, 1 << 20), (None, 12), (7, 12)])
def test_growth_against_a_queue(spark, most, small):
    rng = np.random.default_rng(9)
    shapes = ((7, 6, 5), (4, 9, 8)) if small > 100 else ((4, 3, 3),)
    a = [np.round(rng.random(s), 1) for s in shapes]
    if small < 100:  # a large flat region across bricks, and some noise in it
        a[0][a[0] < 0.7] = 0.5
    df, _ = table(spark, *a)
    found, waves = growth.grown(df, "v", 0.2, most, small=small)
    got = arrays(found.select("case_id", "lin", (F.col("seed") + 1).alias("label")), shapes)
    assert all((g == seeds_by_hand(x, 0.2, most)).all() for g, x in zip(got, a))
    assert waves > 0 if small < 100 else waves == 0


def test_seed_order_by_hand(spark):
    df, _ = table(spark, np.zeros((7, 1, 12)), np.zeros((2, 5, 3)))
    for case, shape in enumerate(((7, 1, 12), (2, 5, 3))):
        got = [(r.x, r.y, r.z) for r in growth.with_priority(df).where(F.col("case_id") == case).orderBy("__priority").collect()]
        axes = [[(n // d + i * growth.stride(n)) % n for i in range(n)] for n, d in zip(shape, (3, 5, 7))]
        assert got == [(x, y, z) for x in axes[0] for y in axes[1] for z in axes[2]]


def test_merging_ends_when_no_pair_is_left(spark):
    rng = np.random.default_rng(6)
    a = [rng.random((6, 6, 6)), rng.random((5, 4, 7))]
    df, _ = table(spark, *a)
    named = df.withColumn("label", F.when(F.col("lin") % 17 > 0, F.expr("lin div 3 + 1")).otherwise(0).cast("long"))
    out = arrays(contract.merge_similar_regions(named, "v", 0.15, 25), [x.shape for x in a])
    before = arrays(named, [x.shape for x in a])
    for label, old, v in zip(out, before, a):
        assert ((label == 0) == (old == 0)).all()
        ids = [i for i in np.unique(label) if i]
        assert all((label == i).sum() <= 25 and i == old[label == i].min() for i in ids)
        assert all(len(np.unique(label[old == i])) == 1 for i in np.unique(old))
        size, mean = {i: (label == i).sum() for i in ids}, {i: v[label == i].mean() for i in ids}
        for k in range(3):
            for p, q in zip(np.moveaxis(label, k, 0)[:-1].ravel(), np.moveaxis(label, k, 0)[1:].ravel()):
                if p != q and p and q:
                    assert size[p] + size[q] > 25 or abs(mean[p] - mean[q]) > 0.15 - 1e-12
    assert len(np.unique(out[0])) < len(np.unique(before[0]))


def test_merging_takes_the_closest_pair_first(spark):
    sums = spark.createDataFrame([(0, k, 1, v) for k, v in enumerate((0.0, 0.5, 0.9, 5.0), 1)], "case_id long, label long, n long, total double")
    links = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4)], "case_id long, lo long, hi long")
    got = {r.label: r.merged for r in regions.merged(sums, links, 0.6, 10).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4}  # 2 and 3 first; their mean is then too far from 1
    assert {r.merged for r in regions.merged(sums, links, 9.0, 2).collect()} == {1, 2, 4}  # the cap holds
    assert regions.merged(sums.limit(0), links.limit(0), 1.0, 9).count() == 0


@pytest.mark.parametrize("group", [1 << 17, 60])
def test_distances_against_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(distance, "GROUP", group)
    rng = np.random.default_rng(7)
    a = [rng.random((7, 6, 9)), rng.random((4, 11, 3)), rng.random((3, 3, 3))]
    df, cases = table(spark, *a)
    cases = cases.withColumns({"sy": F.lit(1.5), "sz": F.lit(0.7)})
    got = column_by_case(distance.with_distance(df, F.col("v") > 0.5, (F.col("v") < 0.05) & (F.col("case_id") < 2), cases))
    space = np.array([1.0, 1.5, 0.7])
    for case, v in enumerate(a):
        mask = np.argwhere(v < 0.05) * space
        for p in np.argwhere(v >= 0):
            lin = np.ravel_multi_index(p, v.shape)
            if v[tuple(p)] > 0.5 and case < 2 and len(mask):
                assert np.isclose(got[case, lin], np.sqrt(((mask - p * space) ** 2).sum(1)).min())
            else:
                assert got[case, lin] is None


def column_by_case(df):
    return {(r.case_id, r.lin): r.distance for r in df.collect()}


def test_envelope_against_all_shifts():
    rng = np.random.default_rng(8)
    f = np.where(rng.random((200, 13)) < 0.4, rng.integers(0, 30, (200, 13)).astype(float), np.inf)
    f[0], f[1] = np.inf, 0.0
    want = (f[:, None, :] + (1.3 * (np.arange(13)[:, None] - np.arange(13)[None])) ** 2).min(2)
    assert np.allclose(distance.envelope(f, 1.3), want)


def test_surface_scores_of_any_choice(spark):
    rng = np.random.default_rng(10)
    label, seg = rng.integers(0, 5, (2, 6, 7, 5)), np.where(rng.random((2, 6, 7, 5)) < 0.4, 2, 0)
    seg[1] = 0
    df, _ = table(spark, *label.astype(float))
    truth = {(c, i): int(s) for c in range(2) for i, s in enumerate(seg[c].ravel())}
    rows = spark.createDataFrame([(c, i, s) for (c, i), s in truth.items()], "case_id long, lin long, seg int")
    held = df.drop("seg").join(rows, ["case_id", "lin"]).withColumn("label", F.col("v").cast("long"))
    choices = [(c, k, list(s)) for c in range(2) for k, s in enumerate([(), (1,), (1, 2), (2, 3, 4), (1, 2, 3, 4)])]
    got = {(r.case_id, r.choice): r.dice for r in evaluate.surface_scores(evaluate.surface_signatures(held), spark.createDataFrame(choices, "case_id long, choice int, labels array<long>")).collect()}

    def edge(m):
        wide = np.pad(m, 1)
        inner = m.copy()
        for k in range(3):
            for d in (-1, 1):
                inner &= np.roll(wide, d, k)[1:-1, 1:-1, 1:-1]
        return m & ~inner

    for c, k, s in choices:
        p, t = edge(np.isin(label[c], list(s))), edge(seg[c] == 2)
        want = 1.0 if not t.any() else 2 * (p & t).sum() / (p.sum() + t.sum() + 1e-8)
        assert np.isclose(got[c, k], want)


def test_region_sums_over_bricks_match_numpy(spark):
    """Sizes, means, deviations, boxes and moments of regions that reach over bricks; equal values deviate by exactly 0."""
    rng = np.random.default_rng(5)
    shape = (7, 6, 9)
    at = np.indices(shape).reshape(3, -1)
    label = (at[0] > 3).astype("i8") + 2 * (at[2] > 4)  # label 0 is no region
    value = np.where(label == 3, 0.1, rng.random(label.size))
    rows = [(1, *map(int, at[:, k]), int(label[k]), None if k % 11 == 0 else float(value[k])) for k in range(label.size)]
    voxels = spark.createDataFrame(rows, "case_id bigint, x int, y int, z int, label bigint, v double")
    found = {r["label"]: r for r in features.region_sums(voxels, F.col("v"), side=3).collect()}
    assert set(found) == {1, 2, 3}
    for k, r in found.items():
        own, seen = label == k, (label == k) & (np.arange(label.size) % 11 != 0)
        assert r["volume"] == own.sum() and np.isclose(r["mean_intensity"], value[seen].mean())
        assert np.isclose(r["intensity_std"], value[seen].std()) and (k != 3 or r["intensity_std"] < 1e-12)
        assert np.allclose(r["centroid"], at[:, own].mean(1))
        assert [r[f"{n}_{a}"] for a in "xyz" for n in ("min", "max")] == [int(f(c[own])) for c in at for f in (np.min, np.max)]
        assert np.allclose([[r["vx"], r["cxy"], r["cxz"]], [r["cxy"], r["vy"], r["cyz"]], [r["cxz"], r["cyz"], r["vz"]]], np.cov(at[:, own]))


def test_numbers_cross_without_a_bound_in_bytes_and_texts_with_the_sessions_own(spark):
    own = spark.conf.get(session.BATCH_BYTES)
    session.ship(spark)
    before = spark.conf.get(session.BATCH_BYTES)
    bricks.face_counts(spark.createDataFrame([(1, 0, 0, 0, 1)], "case_id bigint, x int, y int, z int, label bigint"))
    assert int(spark.conf.get(session.BATCH_BYTES).rstrip("b")) == 2**31 - 1
    session.ship(spark)
    assert spark.conf.get(session.BATCH_BYTES) == before and (own == before or own.startswith(str(2**31 - 1)))


def test_counts_after_deletion_are_those_of_the_voxels(spark):
    rows = [(c, x, x % 5, (x * 7) % 3, float(x % 4) / 4) for c in (1, 2) for x in range(40)]
    voxels = spark.createDataFrame(rows, "case_id bigint, lin int, label bigint, seg int, v double")
    bounds = ("v", 3, 100, 0.0, 0.37)
    want = features.label_counts(contract.delete_nodes(voxels, *bounds))
    assert sorted(map(tuple, features.counts_after_deletion(voxels, *bounds).collect())) == sorted(map(tuple, want.collect()))


def test_distances_by_pairs_are_those_of_the_envelopes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(c, x, y, z, (x * 6 + y) * 6 + z, int(rng.integers(0, 3)) if c else 2) for c in range(3) for x in range(6) for y in range(6) for z in range(6)]
    voxels = spark.createDataFrame(rows, "case_id bigint, x int, y int, z int, lin bigint, seg int")
    cases = spark.createDataFrame([(c, 6, 6, 6, 1.0, 1.25, 2.5) for c in range(3)], "case_id bigint, nx int, ny int, nz int, sx double, sy double, sz double")
    got = []
    for most in (0, 1 << 19):
        monkeypatch.setattr(distance, "PAIRS", most)
        d = distance.with_distance(voxels, F.col("seg") == 2, F.col("seg") == 1, cases, asked=True)
        got.append(sorted((r["case_id"], r["lin"], -1.0 if r["distance"] is None else r["distance"]) for r in d.collect()))
    assert got[0] == got[1] and {c for c, _, d in got[0] if d < 0} == {0}  # case 0 has no mask


@pytest.mark.parametrize("method", ["adaptive", "quantized", "anchored"])
def test_cases_in_one_brick_get_the_labels_of_those_over_many(spark, monkeypatch, method):
    """Missing voxels and values too; with the deletion that both do, and as one table of both kinds of cases."""
    rng = np.random.default_rng(21)
    shapes = ((9, 8, 7), (3, 2, 3), (6, 5, 10))
    a = [np.round(np.where(np.indices(s)[0] < s[0] // 2, 0.2, 0.7) + rng.normal(0, 0.08, s), 3).clip(0, 1) for s in shapes]
    df, _ = table(spark, *a)
    df = df.where("lin % 13 <> 5").withColumn("v", F.when(F.col("lin") % 17 != 4, F.col("v")))

    def found():
        both = contract.labelled(df, "v", method, 0.12, 0.1, 3, 200, 0.1, 0.75, 6, 5)
        return [{(r.case_id, r.lin): r.label for r in t.collect()} for t in both]

    monkeypatch.setattr(bricks, "SIDE", 1 << 10)
    one = found()
    monkeypatch.setattr(bricks, "SIDE", 3)
    assert found() == one and len(set(one[0].values())) > 5 and 0 in one[1].values()


def test_dice_of_counts_is_that_of_the_mask(spark):
    rng = np.random.default_rng(22)
    rows = [(c, i, int(rng.integers(0, 6)), int(rng.integers(0, 3)) * (c > 0)) for c in range(4) for i in range(60)]
    labelled = spark.createDataFrame(rows, "case_id bigint, lin int, label bigint, seg int")
    counts = features.label_counts(labelled)
    for threshold in (0.1, 0.35, 0.5):
        want = evaluate.class_dice(evaluate.three_class_mask(labelled, counts, threshold)).collect()
        assert sorted(map(tuple, evaluate.class_dice_of_counts(counts, threshold).collect())) == sorted(map(tuple, want))


def test_texts_cross_in_batches_of_few_rows_and_numbers_in_the_sessions_own(spark):
    session.ship(spark)
    assert int(spark.conf.get(session.BATCH_ROWS)) == session.TEXTS
    session.ship(spark, numbers=True)
    assert int(spark.conf.get(session.BATCH_ROWS)) >= 10_000


@pytest.mark.parametrize("most", [None, 1, 7, 40])
def test_growth_of_one_volume_by_a_queue(most):
    rng = np.random.default_rng(23)
    for shape in ((7, 6, 5), (4, 9, 8), (1, 1, 1), (2, 5, 3)):
        a = np.round(rng.random(shape), 1)
        framed, held = np.pad(a, 1, constant_values=np.nan), np.pad(np.ones(shape, bool), 1)
        seeds = np.flatnonzero(held)[growth.seed_order([c - 1 for c in np.nonzero(held)])]
        owner = growth.by_queue(framed, held, seeds, 0.2, most)[1:-1, 1:-1, 1:-1]
        lin = np.pad(np.arange(a.size).reshape(shape), 1).ravel()
        assert (lin[owner] + 1 == seeds_by_hand(a, 0.2, most)).all()


def test_cases_in_one_brick_grow_without_a_table_of_extents_and_cross_once(spark):
    df, _ = table(spark, np.zeros((3, 3, 3)))
    plan = contract.anchored_contract(df.select("case_id", "x", "y", "z", "lin", "v"), "v", 0.05, 0.1)._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and "__0" not in plan and "__1" not in plan
