import hashlib

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from voxelgraph.llm import clustering


def by_hand(ids, v, k, rounds):
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), v[i].tolist()))[:k]
    c = v[order].copy()
    nearest = lambda: ((v[:, None] - c[None]) ** 2).sum(2)
    for _ in range(rounds):
        a = nearest().argmin(1)
        for j in range(len(c)):
            if (a == j).any():
                c[j] = v[a == j].sum(0) // (a == j).sum()
    d = nearest()
    return d.argmin(1), d.min(1), c


def table(spark, ids, v):
    return spark.createDataFrame([(i, r) for i, r in zip(ids, v.tolist())], "vec_id long, weights array<long>")


@pytest.mark.parametrize("kind", ["blobs", "ties", "noise", "line"])
def test_against_all_distances(spark, kind):
    rng = np.random.default_rng(5)
    v = {
        "blobs": (rng.integers(0, 6, (700, 1)) * 400 + rng.normal(0, 9, (700, 5))).astype("i8"),
        "ties": rng.integers(0, 2, (700, 3)),
        "noise": rng.normal(0, 300, (400, 16)).astype("i8"),
        "line": np.arange(600)[:, None] * np.array([[3, -4]]),
    }[kind]
    ids = list(range(len(v)))
    assigned, centroids = clustering.clustered(table(spark, ids, v), 12, 4)
    cluster, distance, c = by_hand(ids, v, 12, 4)
    assert (centroids == c).all()
    assert {r.vec_id: (r.cluster, r.distance) for r in assigned.collect()} == {i: (a, d) for i, a, d in zip(ids, cluster.tolist(), distance.tolist())}


def test_bounds_never_exceed_the_distance_and_spare_work():
    rng = np.random.default_rng(6)
    v = (rng.integers(0, 8, (2000, 1)) * 5000 + rng.normal(0, 60, (2000, 8))).astype("i8")
    pivots = v[:20]
    far = np.stack([clustering.squared(v, p) for p in pivots], axis=1)
    bounds = clustering.Bounds(pivots, v[20:60] + 3)
    exact = np.stack([clustering.squared(v, c) for c in bounds.centroids], axis=1)
    assert (bounds.of(far) ** 2 <= exact).all()
    cluster, best, asked = bounds.nearest(v, far)
    assert (cluster == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert asked < 0.6 * exact.size
    # the first round: each centroid is a pivot, so its bound is its distance
    assert clustering.Bounds(pivots, pivots).nearest(v, far)[2] < 1.2 * len(v)


def test_query_by_hand_and_by_sql(spark):
    got = sorted(map(tuple, clustering.op13_clusters(spark, SF).collect()))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    v = np.floor(256 * np.array([r.embedding for r in rows], "f8")).astype("i8")
    cluster, distance, c = by_hand([r.vec_id for r in rows], v, 40, 5)
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    sums = np.bincount(cluster, distance, 40).astype("i8")
    assert got == sorted((r.vec_id, int(a), int(d), int(sums[a]), int(distance.sum()), digest[a]) for r, a, d in zip(rows, cluster, distance))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(con.execute(clustering.OP13_SQL).fetchall()) == got


def test_unusable_repeated_few_and_none(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    x = lambda a: [a] * 64
    rows = [(1, x(0.5)), (1, x(0.5)), (2, x(-0.5)), (None, x(0.25)), (3, None), (4, x(0.5)[1:]), (5, [nan, *x(0.1)[1:]]), (6, [inf, *x(0.1)[1:]]), (7, [None, *x(0.1)[1:]]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("x"), "weights": F.lit(1), "distance": F.lit(2)})
    df.write.parquet(f"{tmp_path}/a/embeddings.parquet")
    got = clustering.op13_clusters(spark, f"{tmp_path}/a").collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.distance) for r in got) == [(False, 1, 0), (False, 1, 0), (False, 2, 0), (True, 0, 0)]
    assert len({r.cluster for r in got}) == 3 and {r.inertia for r in got} == {0}
    df.limit(0).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert clustering.op13_clusters(spark, f"{tmp_path}/b").count() == 0


def test_an_empty_cluster_keeps_its_centroid(spark):
    v = np.array([[0, 0], [10, 0]])
    seeds = np.array([[0, 0], [10, 0], [500, 500]])
    assigned, centroids = clustering.clustered(table(spark, [1, 2], v), 3, 2, seeds)
    assert centroids.tolist() == seeds.tolist() and sorted(r.cluster for r in assigned.collect()) == [0, 1]
