"""Centroid clustering with exact assignments, bounded from below by Ptolemaic pivots.

For any four points of a Euclidean space d(v, c) d(p, q) >= |d(v, p) d(c, q) - d(v, q) d(c, p)| (Ptolemy). The
pivots are the first centroids, each paired once with the pivot farthest from it; every vector's distances to
them are computed once and kept beside it in a staged table. In a round the bounds over all pairs come from those
and from the centroids' few distances to the pivots. A vector is measured exactly, in whole numbers, against the
centroid with the least bound, then against those whose bound doesn't exceed the best so far. Bounds are rounded
down by more than their floating error, so no centroid that could win or tie is ever left out.

Tasks send one sum for each cluster; centroids (``k`` rows) live in the driver. Nothing else is collected, and no
vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgraph.session import ship, staged, table

#: Relative slack of the bounds: some hundred units in the last place, where a bound gathers under ten.
SLACK = 2.0**-46
#: Vectors that are bounded together.
BATCH = 4096


def whole_vectors(rows: DataFrame, id_col: str, vector: str, dims: int, scale: float) -> DataFrame:
    """``(vec_id, weights)``: floor(scale * x), x as a double, of vectors with ``dims`` components, none null or non-finite.

    Squares must sum within 64 bits: whole components below 2^28 in size are safe for 64 of them.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) == dims) & finite).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("bigint")).alias("weights")
    )


def seeded(vectors: DataFrame, k: int, key: int = 2) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of ``key:vec_id``, in its order; without an id last, ties by components."""
    digest = F.sha2(F.concat(F.lit(f"{key}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(digest.alias("digest"), "weights").orderBy(F.asc_nulls_last("digest"), "weights").limit(k).collect()  # k rows
    return np.array([r["weights"] for r in rows], "i8")


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors (rows) from one centroid, or of equally many."""
    gap = v - c
    return np.einsum("ij,ij->i", gap, gap)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Bounds:
    """Lower bounds of distances to centroids, from distances to pivots."""

    def __init__(self, pivots: np.ndarray, centroids: np.ndarray):
        self.centroids = centroids
        between = np.sqrt(np.array([squared(pivots, p) for p in pivots], "f8").reshape(len(pivots), -1))
        far = between.argmax(1) if len(pivots) else np.empty(0, "i8")
        self.pairs = [(int(p), int(q), between[p, q]) for p, q in {(min(p, q), max(p, q)) for p, q in enumerate(far)} if between[p, q] > 0]
        self.near = np.sqrt(np.array([squared(pivots, c) for c in centroids], "f8").reshape(len(centroids), -1))

    def of(self, from_pivots: np.ndarray) -> np.ndarray:
        """A bound for each vector (its squared pivot distances) and centroid; 0 where there is no pair."""
        d = np.sqrt(from_pivots.astype("f8"))
        out = np.zeros((len(d), len(self.centroids)))
        for p, q, apart in self.pairs:
            a, b = d[:, p, None] * self.near[None, :, q], d[:, q, None] * self.near[None, :, p]
            np.maximum(out, (np.abs(a - b) - SLACK * (a + b)) / apart, out=out)
        return out * (1 - SLACK)

    def nearest(self, v: np.ndarray, from_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest centroid, ties to the smaller number; its squared distance; how many distances were computed)."""
        bound = self.of(from_pivots)
        cluster = bound.argmin(1)
        best, asked = squared(v, self.centroids[cluster]), len(v)
        least, guess = bound * bound * (1 - SLACK), cluster.copy()
        for c, centroid in enumerate(self.centroids):
            able = np.flatnonzero((least[:, c] <= best) & (guess != c))
            asked += len(able)
            d = squared(v[able], centroid)
            closer = (d < best[able]) | (d == best[able]) & (c < cluster[able])
            best[able[closer]], cluster[able[closer]] = d[closer], c
        return cluster, best, asked


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            yield batch, _matrix(batch.column("weights")), _matrix(batch.column("from_pivots"))


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` with ``from_pivots``: exact squared distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("weights"))
            far = np.stack([squared(v, p) for p in pivots], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, far.shape[1], dtype="i4")), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("weights"), lists], names=["vec_id", "weights", "from_pivots"])

    return vectors.mapInArrow(run, "vec_id bigint, weights array<bigint>, from_pivots array<bigint>")


def moved(held: DataFrame, bounds: Bounds) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors, componentwise; an empty one stays."""
    dims = bounds.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(bounds.centroids), "i8"), np.zeros(bounds.centroids.shape, "i8")
        for _, v, far in _parts(batches):
            cluster, _, _ = bounds.nearest(v, far)
            n += np.bincount(cluster, minlength=len(n))
            np.add.at(total, cluster, v)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some]), *(pa.array(total[some, k]) for k in range(dims))], names=["cluster", "n", *(f"s{k}" for k in range(dims))])

    schema = ", ".join(["cluster bigint", "n bigint", *(f"s{k} bigint" for k in range(dims))])
    sums = held.mapInArrow(run, schema).groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col(f"s{k}").cast("decimal(38,0)")) for k in range(dims))).alias("total"))
    out = bounds.centroids.copy()
    for r in sums.collect():  # at most k rows
        out[r["cluster"]] = [int(t) // r["n"] for t in r["total"]]
    return out


def clustered(vectors: DataFrame, k: int, rounds: int, seeds: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """((``vec_id, cluster, distance``) for each of ``vectors`` (``vec_id, weights``), centroids) after ``rounds`` moves.

    ``distance`` is squared. With fewer vectors than ``k`` each is a seed; without any there is no row.
    """
    ship(vectors.sparkSession)
    seeds = seeded(vectors, k) if seeds is None else seeds
    if not len(seeds):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), seeds
    held = staged(with_pivots(vectors, seeds))
    centroids = seeds
    for _ in range(rounds):
        centroids = moved(held, Bounds(seeds, centroids))
    bounds = Bounds(seeds, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v, far in _parts(batches):
            cluster, d, _ = bounds.nearest(v, far)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype("i4")), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return held.mapInArrow(run, "vec_id bigint, cluster int, distance bigint"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the sums of distances over its cluster and over all, and the digest of its centroid."""
    spark, held = assigned.sparkSession, staged(assigned)
    names = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    digests = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = held.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = sums.join(F.broadcast(digests), "cluster").crossJoin(F.broadcast(whole))  # k rows, and one row
    return held.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` vectors of 64 usable components in 40 clusters, after 5 rounds.

    Vectors of another length, null, or with null or non-finite components are left out; a vector without an id
    is kept and comes last among seeds; repeated rows each have a row and count each; ties go to the smaller
    cluster; fewer than 40 vectors make as many clusters; an empty table gives no rows.
    """
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, 256.0)
    return with_inertia(*clustered(vectors, 40, 5))


def _round(k: int) -> str:
    """Assignments to the centroids ``c<k>``, and the centroids after them."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT v.id, c.cluster, list_sum(list_transform(list_zip(v.w, c.w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{k} c) GROUP BY id)"""


def _moved(k: int) -> str:
    return f"""
m{k} AS (
  SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.cluster, unnest(v.w) AS x, unnest(range(64)) AS i FROM a{k} a JOIN v ON a.id = v.id) GROUP BY cluster, i),
c{k + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.w, c.w) AS w
  FROM c{k} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM m{k} GROUP BY cluster) m ON c.cluster = m.cluster)"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, w) - 1 AS INT) AS cluster, w FROM v QUALIFY cluster < 40),
{",".join(x for k in range(5) for x in (_round(k), _moved(k)))},
{_round(5)},
s AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a5 GROUP BY cluster)
SELECT v.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance, s.cluster_inertia, CAST((SELECT sum(distance) FROM a5) AS BIGINT) AS inertia, sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM a5 a JOIN v ON a.id = v.id JOIN s ON a.cluster = s.cluster JOIN c5 c ON a.cluster = c.cluster
"""
