from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgraph.operators import contract, features, phenotype, stencil
from voxelgraph.operators import edges as E
from voxelgraph.operators.components import connected_components
from voxelgraph.session import staged


def table(spark, *arrays):
    rows = []
    for case, a in enumerate(arrays):
        nx, ny, nz = a.shape
        rows += [(case, x, y, z, (x * ny + y) * nz + z, float(a[x, y, z]), 0) for x in range(nx) for y in range(ny) for z in range(nz)]
    cases = [(c, *a.shape, 1.0, 1.0, 1.0) for c, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "case_id long, x int, y int, z int, lin long, v double, seg int"), spark.createDataFrame(cases, "case_id long, nx int, ny int, nz int, sx double, sy double, sz double")


def arrays(df, shapes):
    out = [np.zeros(s, "i8") for s in shapes]
    for r in df.collect():
        out[r.case_id].ravel()[r.lin] = r.label
    return out


def flood(a):
    """Components of equal values, each named by its first voxel."""
    out = np.zeros(a.shape, "i8")
    for start in np.ndindex(a.shape):
        if out[start]:
            continue
        name, queue = np.ravel_multi_index(start, a.shape) + 1, deque([start])
        out[start] = name
        while queue:
            p = queue.popleft()
            for k in range(3):
                for d in (-1, 1):
                    q = tuple(c + d * (j == k) for j, c in enumerate(p))
                    if all(0 <= c < n for c, n in zip(q, a.shape)) and not out[q] and a[q] == a[p]:
                        out[q] = name
                        queue.append(q)
    return out


def test_components_of_long_paths_and_lone_nodes(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(500, 400), (7, 7), (900, 900), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {400: 400, 500: 400, 900: 900}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_voxel_components_against_flood_fill(spark):
    rng = np.random.default_rng(0)
    a = [rng.integers(0, 3, (5, 6, 7)).astype(float), rng.integers(0, 2, (4, 4, 4)).astype(float)]
    df, _ = table(spark, *a)
    got = arrays(contract.connected(df, F.col("v")), [x.shape for x in a])
    assert all((g == flood(x)).all() for g, x in zip(got, a))


def kruskal(grad, markers):
    """Minimum spanning forest rooted at the markers, by sorted edges."""
    shape = grad.shape
    idx = np.arange(grad.size).reshape(shape)
    edges = []
    for k in range(3):
        lo, hi = [slice(None)] * 3, [slice(None)] * 3
        lo[k], hi[k] = slice(0, -1), slice(1, None)
        edges += [(max(grad.flat[i], grad.flat[j]), i, j) for i, j in zip(idx[tuple(lo)].ravel(), idx[tuple(hi)].ravel())]
    parent, root = list(range(grad.size)), dict(markers)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, i, j in sorted(edges):
        a, b = find(i), find(j)
        if a != b and not (a in root and b in root):
            parent[a] = b
            if a in root:
                root[b] = root[a]
    return np.array([root.get(find(i), 0) for i in range(grad.size)]).reshape(shape)


def test_watershed_against_kruskal(spark):
    rng = np.random.default_rng(3)
    g = rng.permutation(5 * 5 * 5).reshape(5, 5, 5) / 10.0
    df, _ = table(spark, g)
    markers = {3: 1, 60: 2, 119: 3}
    m = spark.createDataFrame([(0, k, v) for k, v in markers.items()], "case_id long, lin long, marker long")
    assert (arrays(contract.marker_watershed(df, "v", m), [g.shape])[0] == kruskal(g, markers)).all()


def test_anchored_regions_stay_near_their_seed(spark):
    half = np.where(np.arange(6)[None, None, :] < 3, 0.2, 0.8) * np.ones((6, 6, 1))
    df, cases = table(spark, half)
    m = contract.build_minor(df, "v", "anchored", psi=0.05, alpha=0.2, beta_min=1)
    assert m["stats"].first().supernodes == 2 and m["edges"].count() == 0 and m["all_edges"].count() == 1


def test_cap_and_merge(spark):
    df, cases = table(spark, np.full((3, 3, 3), 0.5))
    capped = staged(contract.anchored_contract(df, "v", 0.03, 0.2, beta_max=14))
    sizes = [r["count"] for r in capped.groupBy("label").count().collect()]
    assert sum(sizes) == 27 and max(sizes) <= 14
    merged = contract.merge_similar_regions(capped, "v", 0.2, 27)
    assert merged.select("label").distinct().count() == 1
    assert contract.delete_nodes(merged, "v", 28).select("label").distinct().first().label == 0


def test_adaptive_partition(spark):
    rng = np.random.default_rng(5)
    a = np.where(np.arange(8)[:, None, None] < 4, 0.1, 0.9) * np.ones((1, 8, 8)) + rng.normal(0, 0.005, (8, 8, 8))
    df, _ = table(spark, a)
    out = arrays(contract.adaptive_contract(df, "v", 0.2, 6), [a.shape])[0]
    assert (out > 0).all()
    for label in np.unique(out):
        assert (out == label).sum() <= 30 or np.ptp(a[out == label]) <= 0.3


def test_unknown_method(spark):
    df, cases = table(spark, np.zeros((2, 2, 2)))
    with pytest.raises(ValueError):
        contract.build_minor(df, "v", "kmeans")


def test_shapes_against_numpy(spark):
    rng = np.random.default_rng(7)
    label = rng.integers(1, 4, (6, 7, 8))
    df, cases = table(spark, rng.normal(size=label.shape))
    named = df.withColumn("label", F.element_at(F.array(*map(F.lit, label.ravel().tolist())), (F.col("lin") + 1).cast("int")).cast("long"))
    for r in features.node_features(named, "v", cases).collect():
        at = np.argwhere(label == r.label).astype(float)
        w, v = np.linalg.eigh(np.cov(at.T))
        assert np.isclose(r.elongation, min(w[-1] / (w[0] + 1e-8), 100)) and np.isclose(r.dominant_axis, w[-1])
        assert abs(np.dot(r.dominant_axis_vec, v[:, -1])) > 1 - 1e-6 and np.allclose(r.centroid, at.mean(0))


def test_face_counts_and_surface(spark):
    label = np.ones((2, 2, 2), int)
    label[0] = 2
    df, _ = table(spark, label.astype(float))
    named = df.withColumn("label", F.col("v").cast("long"))
    assert [(r.lo, r.hi, r.shared_faces) for r in E.shared_faces(named).collect()] == [(1, 2, 4)]
    big, _ = table(spark, np.ones((4, 4, 4)))
    assert stencil.with_surface(big, F.col("v") == 1).where("surface").count() == 64 - 8


def seeds_by_hand(a, tolerance, most):
    """Regions grown with a queue, seed after seed, in the order of the strides."""
    step = lambda n: next((s for s in [*range(max(1, int(n / 2.236)), n), *range(max(1, int(n / 2.236)) - 1, 0, -1)] if np.gcd(n, s) == 1), 1)
    axes = [[(n // d + i * step(n)) % n for i in range(n)] for n, d in zip(a.shape, (3, 5, 7))]
    out = np.zeros(a.shape, "i8")
    for seed in ((x, y, z) for x in axes[0] for y in axes[1] for z in axes[2]):
        if out[seed]:
            continue
        name, size, queue = np.ravel_multi_index(seed, a.shape) + 1, 0, deque([seed])
        while queue:
            p = queue.popleft()
            if out[p] or most is not None and size >= most:
                continue
            out[p], size = name, size + 1
            for k in range(3):
                for d in (-1, 1):
                    q = tuple(c + d * (j == k) for j, c in enumerate(p))
                    if all(0 <= c < n for c, n in zip(q, a.shape)) and not out[q] and abs(a[q] - a[seed]) <= tolerance:
                        queue.append(q)
    return out


@pytest.mark.parametrize("most", [None, 7, 40])
def test_anchored_growth_against_a_queue(spark, most):
    rng = np.random.default_rng(9)
    a = [np.round(rng.random(s), 1) for s in ((7, 6, 5), (4, 9, 8))]
    df, _ = table(spark, *a)
    got = arrays(contract.anchored_contract(df, "v", 0.05, 0.2, most), [x.shape for x in a])
    assert all((g == seeds_by_hand(x, 0.2, most)).all() for g, x in zip(got, a))


def test_the_four_volumes_of_the_native_path(spark):
    uniform, z = np.full((10, 10, 10), 0.5), np.arange(10)[None, None, :]
    halves = np.where(z < 5, 0.2, 0.8) * np.ones((10, 10, 1))
    ramp = np.arange(8)[None, None, :] / 7.0 * np.ones((4, 4, 1))
    df, _ = table(spark, uniform, halves, np.full((20, 20, 20), 0.5), ramp)
    build = lambda case, psi, most: contract.build_minor(df.where(F.col("case_id") == case), "v", "anchored_capped", psi, 0.2, 1, most, 0.0, 1.0)["labels"].select("label").distinct().collect()
    found = [build(0, 0.03, 500_000), build(1, 0.05, 500_000), build(2, 0.03, 1000), build(3, 0.03, 500_000)]
    assert [len(found[0]), len(found[1])] == [1, 2] and 4 <= len(found[2]) <= 50 and 2 <= len(found[3]) <= 8
    assert all(r.label > 0 for rows in found for r in rows)


def test_splits_and_refinement_by_hand(spark):
    rng = np.random.default_rng(4)
    a = np.round(rng.random((6, 6, 6)), 2)
    df, _ = table(spark, a)
    refined = df.withColumn("grown", F.lit(1)).withColumn("mixed", F.col("x") < 3)
    key = np.where(np.arange(6)[:, None, None] < 3, np.minimum(np.floor(a * 4), 3), -1.0)
    assert (arrays(contract.split_by_intensity(refined, "v", 0.25), [a.shape])[0] == flood(key)).all()
    labelled = df.withColumn("label", F.when(F.col("x") < 3, 1).otherwise(2).cast("long"))
    out = contract.refine_regions(labelled, "v", labelled.where("label = 1").select("case_id", "label").distinct(), 9).collect()
    assert {r.grown for r in out if r.x >= 3} == {2} and not any(r.mixed for r in out if r.x >= 3)
    fine = {r.grown for r in out if r.mixed} - {2}
    assert fine == {(0 * 6 + y) * 6 + z + contract.FINE for y in (0, 3) for z in (0, 3)}
    alone = contract.refine_regions(labelled.where("x > 0"), "v", labelled.where("label = 1").select("case_id", "label").distinct(), 9)
    assert alone.where("mixed").count() == 0  # no lattice voxel inside: labels stay


def test_distances_and_gradient_against_numpy(spark):
    rng = np.random.default_rng(6)
    a = rng.random((7, 6, 9))
    df, _ = table(spark, a)
    cases = spark.createDataFrame([(0, 1.0, 1.5, 2.5)], "case_id long, sx double, sy double, sz double")
    got = {r.lin: r.distance for r in phenotype.distance_to_mask(df, F.col("v") > 0.5, F.col("v") < 0.05, cases).collect()}
    mask, asked = np.argwhere(a < 0.05) * [1.0, 1.5, 2.5], np.argwhere(a > 0.5)
    want = {int(np.ravel_multi_index(p, a.shape)): np.sqrt(((mask - p * [1.0, 1.5, 2.5]) ** 2).sum(1)).min() for p in asked}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    assert phenotype.distance_to_mask(df, F.col("v") > 0.5, F.lit(False), cases).count() == 0
    wide = np.pad(a, 1, mode="edge")
    smooth = lambda x, k: (np.roll(x, 1, k) + 2 * x + np.roll(x, -1, k)) / 4
    slope = lambda x, k: (np.roll(x, -1, k) - np.roll(x, 1, k)) / 2
    parts = [slope(smooth(smooth(wide, (k + 1) % 3), (k + 2) % 3), k) for k in range(3)]
    want = np.sqrt(sum(p * p for p in parts) / 3)[1:-1, 1:-1, 1:-1]
    got = {r.lin: r.gradient for r in stencil.gradient_magnitude(df, "v").collect()}
    assert np.allclose([got[i] for i in range(a.size)], want.ravel())
