"""Queries over volumes derived from the driver tables, and the same results in DuckDB SQL.

Most run on intensity bins as regions (``binned``), which SQL can label too; the contraction queries run on
whole tables without an SQL twin where SQL is too slow, and the tests hold them against NumPy.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgraph.functions import scalars
from voxelgraph.operators import contract, evaluate, features, learn, phenotype, report, search, stencil
from voxelgraph.operators import edges as E
from voxelgraph.plans import fixture, pipelines
from voxelgraph.session import shared_dir, staged
from voxelgraph.sources import volumes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BINS = 8


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with ``v`` in [0, 1] and one region for each of eight intensity bins on either side of the middle plane."""
    v = fixture.voxels(spark, sf_dir).withColumn("v", scalars.hu_window(F.col("hu"), 0, 200))
    return v.withColumn("label", (scalars.quantize(F.col("v"), BINS) + 1 + BINS * F.expr("x div 8")).cast("bigint"))


_BINNED = ",\nbinned AS (SELECT *, CAST(least(greatest(floor(v * 8), 0), 7) + 1 + 8 * (x // 8) AS BIGINT) AS label FROM (SELECT *, (greatest(least(hu, 200.0), 0.0) - 0.0) / 200.0 AS v FROM voxels) q)"
_COUNTS = ",\ncounts AS (SELECT case_id, label, count(*) AS n, CAST(sum(CASE WHEN seg >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_organ, CAST(sum(CASE WHEN seg = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_tumour FROM binned GROUP BY case_id, label)"
_NEXT = {a: f"lead({{c}}) OVER (PARTITION BY case_id, {', '.join(b for b in 'xyz' if b != a)} ORDER BY {a})" for a in "xyz"}
_LAST = {a: _NEXT[a].replace("lead(", "lag(") for a in "xyz"}
_FACES = ",\npairs AS (" + " UNION ALL ".join(f"SELECT case_id, label AS a, {_NEXT[a].format(c='label')} AS b FROM binned" for a in "xyz") + "),\nfaces AS (SELECT case_id, least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS shared_faces FROM pairs WHERE b IS NOT NULL AND a <> b GROUP BY ALL)"
_ADJ = ",\nmeans AS (SELECT case_id, label, avg(v) AS mean FROM binned GROUP BY case_id, label),\nadj AS (SELECT f.*, abs(p.mean - q.mean) AS mean_diff FROM faces f JOIN means p ON f.case_id = p.case_id AND f.lo = p.label JOIN means q ON f.case_id = q.case_id AND f.hi = q.label)"


def _inner(mask: str) -> str:
    """All six neighbours satisfy a boolean column."""
    return " AND ".join(f"coalesce({w[a].format(c=mask)}, false)" for a in "xyz" for w in (_NEXT, _LAST))


def _cross(u, v) -> list[str]:
    return [f"({u[1]}) * ({v[2]}) - ({u[2]}) * ({v[1]})", f"({u[2]}) * ({v[0]}) - ({u[0]}) * ({v[2]})", f"({u[0]}) * ({v[1]}) - ({u[1]}) * ({v[0]})"]


def _shape(source: str, count: str, least: int, out: str) -> str:
    """Elongation and dominant axis from the moments xx, yy, zz, xy, xz, yz of ``source``, step by step."""
    rows = (("xx - l1", "xy", "xz"), ("xy", "yy - l1", "yz"), ("xz", "yz", "zz - l1"))
    vectors = ", ".join(f"{e} AS v{k}{c}" for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))) for c, e in zip("xyz", _cross(rows[a], rows[b])))
    longest = "CASE WHEN n0 >= n1 AND n0 >= n2 THEN {0} WHEN n1 >= n2 THEN {1} ELSE {2} END"
    steps = [
        "SELECT *, (xx + yy + zz) / 3.0 AS mm FROM {}",
        "SELECT *, (xx - mm) * (xx - mm) + (yy - mm) * (yy - mm) + (zz - mm) * (zz - mm) + 2.0 * (xy * xy + xz * xz + yz * yz) AS p2 FROM {}",
        "SELECT *, CASE WHEN p2 > 1e-24 THEN sqrt(p2 / 6.0) END AS pp FROM {}",
        "SELECT *, (xx - mm) / pp AS qa, (yy - mm) / pp AS qb, (zz - mm) / pp AS qc, xy / pp AS qd, xz / pp AS qe, yz / pp AS qf FROM {}",
        "SELECT *, acos(greatest(least((qa * (qb * qc - qf * qf) - qd * (qd * qc - qf * qe) + qe * (qd * qf - qb * qe)) / 2.0, 1.0), -1.0)) / 3.0 AS phi FROM {}",
        "SELECT *, coalesce(mm + 2.0 * pp * cos(phi), mm) AS l1, coalesce(mm + 2.0 * pp * cos(phi + 2.0 * pi() / 3.0), mm) AS l3 FROM {}",
        f"SELECT *, {vectors} FROM {{}}",
        "SELECT *, " + ", ".join(f"v{k}x * v{k}x + v{k}y * v{k}y + v{k}z * v{k}z AS n{k}" for k in range(3)) + " FROM {}",
        "SELECT *, sqrt(greatest(n0, n1, n2)) AS len, greatest(xx, yy, zz) AS top, " + ", ".join(f"{longest.format(*(f'v{k}{c}' for k in range(3)))} AS best{c}" for c in "xyz") + " FROM {}",
        f"SELECT *, CASE WHEN {count} >= {least} THEN least(l1 / (greatest(l3, 0.0) + 1e-8), 100.0) ELSE 1.0 END AS elongation, CASE WHEN {count} >= {least} THEN l1 ELSE 0.0 END AS dominant_axis, "
        + ", ".join(f"CASE WHEN {count} < {least} THEN {float(c == 'x')} WHEN len > 1e-9 THEN best{c} / len WHEN {first} THEN {float(c == 'x')} WHEN {second} THEN {float(c == 'y')} ELSE {float(c == 'z')} END AS a{c}" for c in "xyz" for first, second in [("xx = top", "yy = top")])
        + " FROM {}",
    ]
    out_steps, last = [], source
    for k, step in enumerate(steps):
        name = out if k == len(steps) - 1 else f"{out}_{k}"
        out_steps.append(f"{name} AS MATERIALIZED ({step.format(last)})")
        last = name
    return ",\n" + ",\n".join(out_steps)


_MOMENTS = "var_samp(x*sx) AS xx, var_samp(y*sy) AS yy, var_samp(z*sz) AS zz, covar_samp(x*sx, y*sy) AS xy, covar_samp(x*sx, z*sz) AS xz, covar_samp(y*sy, z*sz) AS yz"
# in the binned fixture every voxel is foreground, so its surface is the border of the cube
_NODES = (
    ",\nheld AS (SELECT *, NOT (" + _inner("fg") + ") AS surface FROM (SELECT *, label > 0 AS fg FROM binned) q),\n"
    "measured AS (SELECT case_id, label, count(*) AS volume, CAST(sum(CASE WHEN surface THEN 1 ELSE 0 END) AS BIGINT) AS boundary_length, avg(v) AS mean_intensity, stddev_pop(v) AS intensity_std, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, "
    + ", ".join(f"{f}({a}) AS {f}_{a}" for a in "xyz" for f in ("min", "max")) + f", {_MOMENTS} FROM held JOIN cases USING (case_id) GROUP BY case_id, label)"
    + _shape("measured", "volume", 20, "shaped")
    + ",\nnodes AS (SELECT *, 36 * pi() * volume * volume / (pow(boundary_length, 3) + 1e-8) AS compactness FROM shaped)"
)
_BOX = ", ".join(f"{f}_{a}" for a in "xyz" for f in ("min", "max"))
_MORPHOLOGY = "CASE WHEN compactness > 0.6 THEN 'spherical' WHEN elongation > 5 THEN 'irregular' ELSE 'ovoid' END"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL twin (the fixture's tables stand before it)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = "WITH RECURSIVE " + fixture.SQL + sql
        return f

    return add


def _r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, so that the order of a sum doesn't show."""
    return F.round(c, digits).alias(c) if isinstance(c, str) else F.round(c, digits)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(_r(c, digits) if t == "double" else F.col(c) for c, t in df.dtypes))


# sources and stencils


@query("\nSELECT case_id, count(*) AS voxels, CAST(sum(CASE WHEN seg=1 THEN 1 ELSE 0 END) AS BIGINT) AS organ, CAST(sum(CASE WHEN seg=2 THEN 1 ELSE 0 END) AS BIGINT) AS tumour, round(100.0 * sum(CASE WHEN seg=2 THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN seg=1 THEN 1 ELSE 0 END), 1), 6) AS coverage_pct FROM voxels GROUP BY case_id")
def case_summary(spark, sf_dir):
    return _rounded(volumes.case_summary(fixture.voxels(spark, sf_dir)))


@query(_BINNED + "\nSELECT case_id, label, count(*) AS n, round(sum(v), 6) AS total FROM binned GROUP BY case_id, label")
def windowed_bins(spark, sf_dir):
    return binned(spark, sf_dir).groupBy("case_id", "label").agg(F.count("*").alias("n"), _r(F.sum("v")).alias("total"))


@query(",\nm AS (SELECT *, seg >= 1 AS o FROM voxels), s AS (SELECT *, o AND NOT (" + _inner("o") + ") AS surface FROM m)\nSELECT case_id, CAST(sum(CASE WHEN surface THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN surface THEN lin ELSE 0 END) AS BIGINT) AS places FROM s GROUP BY case_id")
def organ_surface(spark, sf_dir):
    held = stencil.with_surface(fixture.voxels(spark, sf_dir).drop("hu"), scalars.class_mask(F.col("seg"), "any"))
    return held.groupBy("case_id").agg(F.sum(F.col("surface").cast("bigint")).alias("n"), F.sum(F.when(F.col("surface"), F.col("lin")).otherwise(0)).alias("places"))


@query(_BINNED + f",\ne AS (SELECT case_id, z, coalesce({_LAST['x'].format(c='label')} <> label, false) OR coalesce({_LAST['y'].format(c='label')} <> label, false) AS edge FROM binned)\nSELECT case_id, z, CAST(sum(CASE WHEN edge THEN 1 ELSE 0 END) AS BIGINT) AS n FROM e GROUP BY case_id, z")
def slice_boundaries(spark, sf_dir):
    return stencil.label_boundary_2d(binned(spark, sf_dir)).groupBy("case_id", "z").agg(F.sum(F.col("edge").cast("bigint")).alias("n"))


@query(",\nb AS (SELECT case_id, z, sum(CASE WHEN seg=2 THEN 1 ELSE 0 END) AS n FROM voxels GROUP BY case_id, z), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, z) AS k FROM b)\nSELECT case_id, z, CAST(n AS BIGINT) AS n, CAST(greatest(z - 5, 0) AS INT) AS before, CAST(least(z + 5, 15) AS INT) AS after FROM r WHERE k = 1")
def best_slice(spark, sf_dir):
    return stencil.best_slice(fixture.voxels(spark, sf_dir))


@query("\nSELECT case_id, lin, row_number() OVER (PARTITION BY case_id ORDER BY lin) AS marker FROM voxels WHERE x % 5 = 0 AND y % 5 = 0 AND z % 5 = 0 AND seg >= 1")
def lattice_markers(spark, sf_dir):
    return stencil.lattice_markers(fixture.voxels(spark, sf_dir), 5, F.col("seg") >= 1)


_SOBEL_P = {
    a: f"(coalesce({_LAST[a].format(c='{c}')}, {{c}}) + 2.0 * {{c}} + coalesce({_NEXT[a].format(c='{c}')}, {{c}})) / 4.0" for a in "xyz"
}
_SOBEL_D = {a: f"(coalesce({_NEXT[a].format(c='{c}')}, {{c}}) - coalesce({_LAST[a].format(c='{c}')}, {{c}})) / 2.0" for a in "xyz"}
_SOBEL = (
    _BINNED
    + f",\ng1 AS (SELECT *, {_SOBEL_P['x'].format(c='v')} AS p, {_SOBEL_D['x'].format(c='v')} AS d FROM binned)"
    + f",\ng2 AS (SELECT *, {_SOBEL_P['y'].format(c='p')} AS pp, {_SOBEL_D['y'].format(c='p')} AS pd, {_SOBEL_P['y'].format(c='d')} AS dp FROM g1)"
    + f",\ng3 AS (SELECT *, {_SOBEL_D['z'].format(c='pp')} AS a, {_SOBEL_P['z'].format(c='pd')} AS b, {_SOBEL_P['z'].format(c='dp')} AS c FROM g2)"
)


@query(_SOBEL + "\nSELECT case_id, label, round(sum(sqrt((a*a + b*b + c*c) / 3.0)), 6) AS total, round(max(sqrt((a*a + b*b + c*c) / 3.0)), 6) AS steepest FROM g3 GROUP BY case_id, label")
def gradient_by_region(spark, sf_dir):
    g = stencil.gradient_magnitude(binned(spark, sf_dir).select("case_id", *stencil.AXES, "label", "v"), "v")
    return g.groupBy("case_id", "label").agg(_r(F.sum("gradient")).alias("total"), _r(F.max("gradient")).alias("steepest"))


# edges


@query(_BINNED + _FACES + "\nSELECT case_id, lo, hi, shared_faces FROM faces")
def shared_faces(spark, sf_dir):
    return E.shared_faces(binned(spark, sf_dir))


@query(_BINNED + _FACES + _ADJ + "\nSELECT case_id, lo, hi, shared_faces, round(mean_diff, 6) AS mean_diff FROM adj")
def full_adjacency(spark, sf_dir):
    return _rounded(E.full_adjacency(binned(spark, sf_dir), "v"))


@query(_BINNED + _FACES + _ADJ + "\nSELECT case_id, lo, hi, shared_faces, round(mean_diff, 6) AS mean_diff FROM adj WHERE mean_diff <= 0.2")
def adjacency(spark, sf_dir):
    return _rounded(E.adjacency(binned(spark, sf_dir), "v", 0.2))


@query(_BINNED + _FACES + ",\ni AS (SELECT case_id, label, row_number() OVER (PARTITION BY case_id ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT case_id, label FROM binned) q), e AS (SELECT case_id, lo AS s, hi AS d, shared_faces FROM faces UNION ALL SELECT case_id, hi, lo, shared_faces FROM faces)\nSELECT e.case_id, p.idx AS src, q.idx AS dst, shared_faces FROM e JOIN i p ON e.case_id = p.case_id AND e.s = p.label JOIN i q ON e.case_id = q.case_id AND e.d = q.label")
def indexed_edges(spark, sf_dir):
    labelled = binned(spark, sf_dir)
    i = E.dense_index(labelled.select("case_id", "label").distinct())
    e = E.bidirectional(E.shared_faces(labelled))
    s, d = i.toDF("case_id", "src", "s"), i.toDF("case_id", "dst", "d")
    return e.join(s, ["case_id", "src"]).join(d, ["case_id", "dst"]).select("case_id", F.col("s").alias("src"), F.col("d").alias("dst"), "shared_faces")


@query(_BINNED + _COUNTS + _FACES + ",\nk AS (SELECT case_id, label FROM counts WHERE n_organ > 0.3 * n), e AS (SELECT f.case_id, count(*) AS edges FROM faces f JOIN k p ON f.case_id = p.case_id AND f.lo = p.label JOIN k q ON f.case_id = q.case_id AND f.hi = q.label GROUP BY f.case_id), v AS (SELECT case_id, count(*) AS nodes FROM k GROUP BY case_id)\nSELECT c.case_id, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges, round(coalesce(edges, 0) / greatest(coalesce(nodes, 0), 1), 6) AS ratio, coalesce(edges, 0) = 0 AS no_edges FROM cases c LEFT JOIN v USING (case_id) LEFT JOIN e USING (case_id)")
def organ_edge_sparsity(spark, sf_dir):
    labelled = binned(spark, sf_dir)
    nodes = features.label_counts(labelled).where("n_organ > 0.3 * n").select("case_id", "label")
    return _rounded(E.edge_sparsity(fixture.cases(spark, sf_dir), nodes, E.subgraph(E.shared_faces(labelled), nodes)))


# features


@query(_BINNED + _NODES + f"\nSELECT case_id, label, volume, boundary_length, compactness, round(mean_intensity, 6) AS mean_intensity, round(intensity_std, 6) AS intensity_std, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, {_BOX}, round(elongation, 4) AS elongation, round(dominant_axis, 4) AS dominant_axis FROM nodes")
def node_features(spark, sf_dir):
    n = features.node_features(binned(spark, sf_dir), "v", fixture.cases(spark, sf_dir))
    c = [F.round(F.col("centroid")[k], 6).alias(f"c{'xyz'[k]}") for k in range(3)]
    return n.select("case_id", "label", "volume", "boundary_length", "compactness", _r("mean_intensity"), _r("intensity_std"), *c, *_BOX.split(", "), _r("elongation", 4), _r("dominant_axis", 4))


@query(_BINNED + _NODES + "\nSELECT case_id, label, round(elongation, 4) AS elongation, round(dominant_axis, 4) AS dominant_axis, round(abs(ax), 4) AS ax, round(abs(ay), 4) AS ay, round(abs(az), 4) AS az FROM nodes")
def node_shapes(spark, sf_dir):
    """Shapes; of the axis, whose sign is free, the sizes of its parts."""
    n = features.node_features(binned(spark, sf_dir), "v", fixture.cases(spark, sf_dir))
    return n.select("case_id", "label", _r("elongation", 4), _r("dominant_axis", 4), *(F.round(F.abs(F.col("dominant_axis_vec")[k]), 4).alias(f"a{'xyz'[k]}") for k in range(3)))


_SUPERNODE = ",\nown AS (SELECT *, " + " OR ".join(f"coalesce({w[a].format(c='label')}, 0) <> label" for a in "xyz" for w in (_NEXT, _LAST)) + " AS surface FROM binned)"


@query(_BINNED + _SUPERNODE + "\nSELECT case_id, label, count(*) AS volume, CAST(sum(CASE WHEN surface THEN 1 ELSE 0 END) AS BIGINT) AS boundary_length, round(36 * pi() * count(*) * count(*) / (pow(sum(CASE WHEN surface THEN 1 ELSE 0 END), 3) + 1e-8), 6) AS compactness FROM own GROUP BY case_id, label")
def supernode_boundaries(spark, sf_dir):
    n = features.node_features(binned(spark, sf_dir), "v", fixture.cases(spark, sf_dir), boundary="supernode")
    return n.select("case_id", "label", "volume", "boundary_length", _r("compactness"))


def _ratio(name: str, digits: int = 6) -> str:
    return f"round(ln(a.{name} / (b.{name} + 1e-8) + 1e-8), {digits})"


_DIST = "sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) + (a.cz-b.cz)*(a.cz-b.cz))"


_COSINE = "abs((a.ax*b.ax + a.ay*b.ay + a.az*b.az) / ((sqrt(a.ax*a.ax + a.ay*a.ay + a.az*a.az) + 1e-8) * (sqrt(b.ax*b.ax + b.ay*b.ay + b.az*b.az) + 1e-8)))"
_EDGES = _FACES + ",\nedged AS (SELECT f.case_id, f.lo, f.hi, " + ", ".join(
    f"{e} AS {n}"
    for n, e in (
        ("log_volume_ratio", _ratio("volume")),
        ("intensity_diff_norm", "round(abs(a.mean_intensity - b.mean_intensity) / greatest(abs(a.mean_intensity) + abs(b.mean_intensity), 1e-8), 6)"),
        ("distance_norm", f"round({_DIST} / 16, 6)"),
        ("orientation_cos", f"round({_COSINE}, 4)"),
        ("log_compactness_ratio", _ratio("compactness")),
        ("log_elongation_ratio", _ratio("elongation", 4)),
        ("log_boundary_ratio", _ratio("boundary_length")),
        ("log_std_ratio", _ratio("intensity_std")),
        ("shared_boundary", "CAST(f.shared_faces AS DOUBLE)"),
        ("frac_a", "round(f.shared_faces / (a.boundary_length + 1e-8), 4)"),
        ("frac_b", "round(f.shared_faces / (b.boundary_length + 1e-8), 4)"),
        ("intensity_gradient", f"round(abs(a.mean_intensity - b.mean_intensity) / ({_DIST} + 1e-8), 6)"),
    )
) + " FROM faces f JOIN nodes a ON f.case_id = a.case_id AND f.lo = a.label JOIN nodes b ON f.case_id = b.case_id AND f.hi = b.label)"


def edged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve features of every edge."""
    labelled, cases = binned(spark, sf_dir), fixture.cases(spark, sf_dir)
    faces = staged(E.shared_faces(labelled))
    out = features.edge_features(faces, staged(features.node_features(labelled, "v", cases)), faces, cases)
    digits = {"orientation_cos": 4, "log_elongation_ratio": 4, "frac_a": 4, "frac_b": 4}
    return out.select("case_id", "lo", "hi", *(_r(c, digits.get(c, 6)) for c in features.EDGE_FEATURES))


@query(_BINNED + _NODES + _FACES + f"\nSELECT f.case_id, f.lo, f.hi, round(abs(a.cx - b.cx) / ({_DIST} + 1e-8), 6) AS orientation_cos FROM faces f JOIN nodes a ON f.case_id = a.case_id AND f.lo = a.label JOIN nodes b ON f.case_id = b.case_id AND f.hi = b.label")
def edge_offsets(spark, sf_dir):
    """The other reading of an edge's orientation: how far its centroids' offset goes along the first axis."""
    labelled, cases = binned(spark, sf_dir), fixture.cases(spark, sf_dir)
    faces = staged(E.shared_faces(labelled))
    out = features.edge_features(faces, staged(features.node_features(labelled, "v", cases)), faces, cases, "offset")
    return out.select("case_id", "lo", "hi", _r("orientation_cos"))


@query(_BINNED + _NODES + _EDGES + "\nSELECT * FROM edged")
def edge_features(spark, sf_dir):
    return edged(spark, sf_dir)


@query(_BINNED + _NODES + _EDGES + _COUNTS + ",\nk AS (SELECT case_id, label FROM counts WHERE n_organ / n > 0.3)\nSELECT e.case_id, lo, hi, log_volume_ratio, intensity_diff_norm, distance_norm, orientation_cos FROM edged e JOIN k p ON e.case_id = p.case_id AND e.lo = p.label JOIN k q ON e.case_id = q.case_id AND e.hi = q.label")
def organ_subgraph(spark, sf_dir):
    """Edges between regions mostly in the organ, with the four features that such a graph has."""
    labelled, cases = binned(spark, sf_dir), fixture.cases(spark, sf_dir)
    context = features.context_features(labelled, staged(features.node_features(labelled, "v", cases)), "v", cases)
    _, edges = features.organ_subgraph(staged(context), edged(spark, sf_dir))
    return edges.select("case_id", "lo", "hi", *features.ORGAN_EDGE_FEATURES)


@query(_BINNED + _FACES + "\nSELECT case_id, lo, hi, shared_faces FROM faces WHERE lo = 1 AND hi = 9")
def faces_between(spark, sf_dir):
    """Faces between the darkest regions on both sides of the middle plane."""
    return E.shared_faces_between(E.shared_faces(binned(spark, sf_dir)), 9, 1)


@query(_BINNED + ",\nm AS (SELECT *, seg >= 1 AS o FROM binned), s AS (SELECT *, o AND NOT (" + _inner("o") + ") AS os FROM m), p AS (SELECT case_id, label, avg(CASE WHEN o THEN 1.0 ELSE 0.0 END) AS fr, avg(CASE WHEN os THEN 1.0 ELSE 0.0 END) AS ct, avg(v) AS mv, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM s GROUP BY case_id, label), w AS (SELECT case_id, avg(x) AS ox, avg(y) AS oy, avg(z) AS oz, avg(v) AS ov FROM m WHERE o GROUP BY case_id)\nSELECT p.case_id, label, round(fr, 6) AS organ_fraction, round(sqrt((cx-ox)*(cx-ox) + (cy-oy)*(cy-oy) + (cz-oz)*(cz-oz)) / 16, 6) AS dist_to_organ_center, round(mv - ov, 6) AS relative_intensity, round(ct, 6) AS organ_boundary_contact FROM p JOIN w USING (case_id)")
def context_features(spark, sf_dir):
    labelled, cases = binned(spark, sf_dir), fixture.cases(spark, sf_dir)
    nodes = features.node_features(labelled, "v", cases)
    return _rounded(features.context_features(labelled, nodes, "v", cases).select("case_id", "label", *features.CONTEXT_FEATURES))


@query(_BINNED + _NODES + ",\nb AS (SELECT case_id, min(mean_intensity) AS l, max(mean_intensity) AS h, min(volume) AS lv, max(volume) AS hv FROM nodes GROUP BY case_id)\nSELECT n.case_id, label, round(CASE WHEN h - l > 1e-8 THEN (mean_intensity - l) / (h - l) ELSE mean_intensity END, 6) AS mean_intensity, round(CASE WHEN hv - lv > 1e-8 THEN (volume - lv) / (hv - lv) ELSE CAST(volume AS DOUBLE) END, 6) AS volume FROM nodes n JOIN b USING (case_id)")
def scaled_features(spark, sf_dir):
    n = features.node_features(binned(spark, sf_dir), "v", fixture.cases(spark, sf_dir))
    return _rounded(features.minmax_scale(staged(n.select("case_id", "label", "mean_intensity", "volume")), ("mean_intensity", "volume")))


@query(_BINNED + _COUNTS + "\nSELECT case_id, label, n, n_organ, n_tumour, CASE WHEN n_tumour / n > 0.1 THEN 1 ELSE 0 END AS y FROM counts")
def label_counts(spark, sf_dir):
    return features.label_counts(binned(spark, sf_dir)).where("label > 0").withColumn("y", features.is_tumour())


@query(_BINNED + _COUNTS + "\nSELECT case_id, count(*) AS regions, min(n) AS least, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean, max(n) AS greatest FROM counts WHERE n_tumour / n > 0.1 GROUP BY case_id")
def tumour_sizes(spark, sf_dir):
    return _rounded(features.tumour_size_distribution(features.label_counts(binned(spark, sf_dir))))


# deletion, lifting, scores

_KEPT = _BINNED + ",\nst AS (SELECT case_id, label, count(*) AS n, avg(v) AS m FROM binned GROUP BY case_id, label), kp AS (SELECT case_id, label, row_number() OVER (PARTITION BY case_id ORDER BY label) AS new FROM st WHERE n BETWEEN 100 AND 2000 AND m BETWEEN 0.05 AND 0.95), kept AS (SELECT b.* REPLACE (coalesce(new, 0) AS label) FROM binned b LEFT JOIN kp USING (case_id, label))"
_KCOUNTS = _COUNTS.replace("FROM binned", "FROM kept").replace("counts AS", "kcounts AS")


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.delete_nodes(binned(spark, sf_dir), "v", 100, 2000, 0.05, 0.95)


def kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label_counts`` of ``kept``, without voxels that carry new labels."""
    return staged(features.counts_after_deletion(binned(spark, sf_dir), "v", 100, 2000, 0.05, 0.95))


@query(_KEPT + "\nSELECT case_id, label, count(*) AS n, CAST(sum(lin) AS BIGINT) AS places FROM kept GROUP BY case_id, label")
def delete_nodes(spark, sf_dir):
    return kept(spark, sf_dir).groupBy("case_id", "label").agg(F.count("*").alias("n"), F.sum("lin").alias("places"))


def _score_sql(cond: str, empty: str) -> str:
    b, g, p = f"sum(CASE WHEN label > 0 AND {cond} THEN n_tumour ELSE 0 END)", "sum(n_tumour)", f"sum(CASE WHEN label > 0 AND {cond} THEN n ELSE 0 END)"
    none = "1.0" if empty == "one" else f"CASE WHEN {p} = 0 THEN 1.0 ELSE 0.0 END"
    return f"round(CASE WHEN {g} = 0 THEN {none} ELSE 2.0 * {b} / ({g} + {p} + 1e-8) END, 6) AS dice, round(CASE WHEN {g} > 0 THEN {b} / {g} ELSE 0.0 END, 6) AS recall, round(CASE WHEN {p} > 0 THEN {b} / {p} ELSE 0.0 END, 6) AS precision"


@query(_KEPT + _KCOUNTS + f"\nSELECT case_id, {_score_sql('n_tumour / n > 0.1', 'agree')}, CAST(sum(CASE WHEN label > 0 AND n_tumour / n > 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS tumour_supernodes, CAST(sum(CASE WHEN label = 0 THEN n_tumour ELSE 0 END) AS BIGINT) AS lost FROM kcounts GROUP BY case_id")
def oracle_scores(spark, sf_dir):
    c = kept_counts(spark, sf_dir)
    o = evaluate.oracle(c).select("case_id", "dice", "recall", "precision", "tumour_supernodes")
    return _rounded(o.join(evaluate.deletion_loss(c).select("case_id", "lost"), "case_id"))


@query(_KEPT + _KCOUNTS + f",\nv AS (SELECT case_id, {_score_sql('n_tumour / n > 0.1', 'one')} FROM kcounts GROUP BY case_id)\nSELECT case_id, dice, round(100.0 * sum(CASE WHEN n_tumour / n > 0.1 AND n >= 150 THEN n_tumour ELSE 0 END) / greatest(sum(n_tumour), 1), 6) AS capture_pct FROM kcounts JOIN v USING (case_id) GROUP BY case_id, dice")
def volume_dice_and_capture(spark, sf_dir):
    c = kept_counts(spark, sf_dir)
    return _rounded(evaluate.volume_dice(c).join(evaluate.tumour_capture(c, 150), "case_id"))


_LIFTED = _KEPT + _KCOUNTS + ",\nl AS (SELECT k.*, CASE WHEN k.label > 0 AND c.n_tumour / c.n > 0.1 THEN true ELSE false END AS p, seg = 2 AS t FROM kept k JOIN kcounts c USING (case_id, label))"


@query(_LIFTED + ",\ns AS (SELECT case_id, p AND NOT (" + _inner("p") + ") AS a, t AND NOT (" + _inner("t") + ") AS b FROM l), q AS (SELECT case_id, sum(CASE WHEN a AND b THEN 1 ELSE 0 END) AS n, sum(CASE WHEN b THEN 1 ELSE 0 END) AS g, sum(CASE WHEN a THEN 1 ELSE 0 END) AS p FROM s GROUP BY case_id)\nSELECT case_id, round(CASE WHEN g = 0 THEN 1.0 ELSE 2.0 * n / (g + p + 1e-8) END, 6) AS dice FROM q")
def boundary_dice(spark, sf_dir):
    labelled = staged(kept(spark, sf_dir))
    return _rounded(evaluate.boundary_dice(labelled, features.label_counts(labelled)))


@query(_KEPT + _KCOUNTS + ",\nm AS (SELECT k.case_id, k.seg, CASE WHEN c.n_tumour / c.n > 0.1 THEN 2 WHEN (c.n_organ - c.n_tumour) / c.n > 0.1 THEN 1 ELSE 0 END AS pred FROM kept k JOIN kcounts c USING (case_id, label)), q AS (SELECT case_id, k, sum(CASE WHEN pred = k AND seg = k THEN 1 ELSE 0 END) AS n, sum(CASE WHEN seg = k THEN 1 ELSE 0 END) AS g, sum(CASE WHEN pred = k THEN 1 ELSE 0 END) AS p FROM m, (VALUES (1), (2)) c(k) GROUP BY case_id, k), d AS (SELECT case_id, k, round(CASE WHEN g = 0 THEN CASE WHEN p = 0 THEN 1.0 ELSE 0.0 END ELSE 2.0 * n / (g + p + 1e-8) END, 6) AS dice FROM q)\nSELECT a.case_id, a.dice AS tumour_dice, b.dice AS organ_dice FROM d a JOIN d b ON a.case_id = b.case_id AND a.k = 2 AND b.k = 1")
def class_dice(spark, sf_dir):
    labelled = staged(kept(spark, sf_dir))
    return _rounded(evaluate.class_dice(evaluate.three_class_mask(labelled, features.label_counts(labelled))))


@query(_KEPT + _KCOUNTS + f",\nv AS (SELECT case_id, {_score_sql('n_tumour / n > 0.1', 'agree')} FROM kcounts GROUP BY case_id)\nSELECT CASE case_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END AS split, count(*) AS cases, round(avg(dice), 5) AS mean_dice, round(quantile_cont(dice, 0.5), 5) AS median_dice, round(stddev_pop(dice), 5) AS std_dice, round(avg(recall), 5) AS mean_recall, round(avg(precision), 5) AS mean_precision FROM v GROUP BY ROLLUP (CASE case_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END)")
def split_summary(spark, sf_dir):
    c = kept_counts(spark, sf_dir)
    s = _rounded(evaluate.oracle(c).select("case_id", "dice", "recall", "precision"))
    m = F.col("case_id") % 3
    splits = fixture.cases(spark, sf_dir).select("case_id", F.when(m == 0, "test").when(m == 1, "train").otherwise("val").alias("split"))
    return _rounded(evaluate.split_summary(s, splits), 5)


# components, distances, phenotypes

_TUMOURS = ",\nt AS MATERIALIZED (SELECT case_id, x, y, z, lin, hu FROM voxels WHERE seg = 2), e AS MATERIALIZED (SELECT a.case_id, a.lin AS l, b.lin AS m FROM t a JOIN t b ON a.case_id = b.case_id AND abs(a.x-b.x) + abs(a.y-b.y) + abs(a.z-b.z) = 1), r AS (SELECT case_id, lin AS root, lin FROM t UNION SELECT r.case_id, r.root, e.m FROM r JOIN e ON r.case_id = e.case_id AND r.lin = e.l), comp AS (SELECT case_id, lin, min(root) + 1 AS label FROM r GROUP BY case_id, lin)"
_DISTANCE = ",\no AS (SELECT case_id, x, y, z FROM voxels WHERE seg = 1), far AS (SELECT v.case_id, v.lin, min(sqrt((v.x-o.x)*(v.x-o.x)*sx*sx + (v.y-o.y)*(v.y-o.y)*sy*sy + (v.z-o.z)*(v.z-o.z)*sz*sz)) AS d FROM voxels v JOIN cases USING (case_id) JOIN o ON v.case_id = o.case_id WHERE v.seg = 2 GROUP BY v.case_id, v.lin)"




@query(_TUMOURS + "\nSELECT case_id, label, count(*) AS n, CAST(sum(lin) AS BIGINT) AS places FROM comp GROUP BY case_id, label")
def tumour_components(spark, sf_dir):
    cc = contract.connected(fixture.voxels(spark, sf_dir), F.when(F.col("seg") == 2, F.lit(2)))
    return cc.where("label > 0").groupBy("case_id", "label").agg(F.count("*").alias("n"), F.sum("lin").alias("places"))


@query(_DISTANCE + "\nSELECT case_id, count(*) AS n, round(min(d), 6) AS nearest, round(avg(d), 6) AS mean, round(max(d), 6) AS farthest FROM far GROUP BY case_id")
def tumour_distances(spark, sf_dir):
    v = fixture.voxels(spark, sf_dir)
    d = phenotype.distance_to_mask(v, F.col("seg") == 2, F.col("seg") == 1, fixture.cases(spark, sf_dir))
    return _rounded(d.groupBy("case_id").agg(F.count("*").alias("n"), F.min("distance").alias("nearest"), F.avg("distance").alias("mean"), F.max("distance").alias("farthest")))


_GT = _DISTANCE + ",\ns AS (SELECT case_id, sum(CASE WHEN seg=2 THEN 1 ELSE 0 END) AS t, sum(CASE WHEN seg=1 THEN 1 ELSE 0 END) AS o FROM voxels GROUP BY case_id), gt AS (SELECT s.case_id, CAST(t AS BIGINT) AS tumour_voxels, CAST(o AS BIGINT) AS organ_voxels, t*sx*sy*sz/1000.0 AS tumour_cm3, o*sx*sy*sz/1000.0 AS organ_cm3, 100.0*t/greatest(o, 1) AS coverage_pct, 2.0*pow(3.0*t*sx*sy*sz/(4.0*pi()), 1.0/3.0) AS diameter_mm, f.d AS distance_to_organ_mm FROM s JOIN cases USING (case_id) JOIN (SELECT case_id, min(d) AS d FROM far GROUP BY case_id) f ON s.case_id = f.case_id WHERE t > 0)"


_MIDS = ",\nmids AS (SELECT case_id, " + ", ".join(f"coalesce(avg(CASE WHEN seg = {k} THEN {a} END), 0) AS {n}{a}, avg(CASE WHEN seg = {k} THEN {a} END) AS {n}{a}_" for n, k in (("t", 2), ("o", 1)) for a in "xyz") + " FROM voxels GROUP BY case_id)"
_GT_ROWS = "tumour_voxels, organ_voxels, round(tumour_cm3, 6) AS tumour_cm3, round(organ_cm3, 6) AS organ_cm3, round(coverage_pct, 6) AS coverage_pct, round(diameter_mm, 6) AS diameter_mm, round(distance_to_organ_mm, 6) AS distance_to_organ_mm, " + ", ".join(f"round({n}{a} * s{a}, 6) AS {w}_{a}" for n, w in (("t", "tumour"), ("o", "organ")) for a in "xyz")


def _centred(df: DataFrame) -> DataFrame:
    """Both centroids as columns."""
    at = [F.col(f"{w}_centroid_mm")[k].alias(f"{w}_{a}") for w in ("tumour", "organ") for k, a in enumerate("xyz")]
    return _rounded(df.select(*(c for c in df.columns if not c.endswith("centroid_mm")), *at))


@query(_GT + _MIDS + f"\nSELECT case_id, {_GT_ROWS} FROM gt JOIN mids USING (case_id) JOIN cases USING (case_id)")
def gt_phenotypes(spark, sf_dir):
    return _centred(phenotype.gt_phenotypes(fixture.voxels(spark, sf_dir), fixture.cases(spark, sf_dir)))


_HU = "avg(hu) AS hm, stddev_pop(hu) AS hs, min(hu) AS h0, max(hu) AS h1, max(x)-min(x)+1 AS bx, max(y)-min(y)+1 AS by_, max(z)-min(z)+1 AS bz"
_HU_ROWS = "round(bx*sx, 6) AS box_x, round(by_*sy, 6) AS box_y, round(bz*sz, 6) AS box_z, round(hm, 6) AS hu_mean, round(hs, 6) AS hu_std, h0 AS hu_min, h1 AS hu_max"
_RELATIVE = "(tz-oz_)/greatest(1.0, abs(oz_))"


@query(_GT + _MIDS + f",\nb AS (SELECT case_id, {_HU} FROM voxels WHERE seg = 2 GROUP BY case_id)\nSELECT case_id, {_GT_ROWS}, {_HU_ROWS}, dataset, sx, sy, sz, CASE WHEN oz_ IS NULL THEN 'unknown' WHEN {_RELATIVE} < -0.3 THEN 'tail' WHEN {_RELATIVE} > 0.3 THEN 'head' ELSE 'body' END AS subregion, CASE WHEN diameter_mm <= 20 THEN 'T1' WHEN diameter_mm <= 40 THEN 'T2' WHEN tumour_cm3 <= 50 THEN 'T3' ELSE 'T4' END AS t_stage FROM gt JOIN mids USING (case_id) JOIN b USING (case_id) JOIN cases USING (case_id)")
def case_metadata(spark, sf_dir):
    return _centred(phenotype.case_metadata(fixture.voxels(spark, sf_dir), fixture.cases(spark, sf_dir)))


_STAGED = "CASE WHEN {d} <= 20 THEN 'T1' WHEN {d} <= 40 THEN 'T2' WHEN {v} <= 50 THEN 'T3' ELSE 'T4' END"


@query(_TUMOURS + _DISTANCE + ",\ns AS (SELECT case_id, CAST(sum(CASE WHEN seg=1 THEN 1 ELSE 0 END) AS BIGINT) AS o, avg(CASE WHEN seg=1 THEN z END) AS oz FROM voxels GROUP BY case_id), k AS (SELECT case_id, count(DISTINCT label) AS k FROM comp GROUP BY case_id), "
       f"m AS (SELECT case_id, label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, {_HU}, coalesce(min(d), 0) AS near, coalesce(avg(d), 0) AS far_ FROM comp JOIN t USING (case_id, lin) LEFT JOIN far USING (case_id, lin) GROUP BY case_id, label), "
       "w AS (SELECT *, n*sx*sy*sz/1000.0 AS cm3, 2.0*pow(3.0*n*sx*sy*sz/(4.0*pi()), 1.0/3.0) AS d FROM m JOIN cases USING (case_id))\n"
       f"SELECT case_id, label, n AS voxels, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, {_HU_ROWS}, round(near, 6) AS distance, round(far_, 6) AS mean_distance, o AS organ_voxels, k AS n_tumours, dataset, sx, sy, sz, round(cm3, 6) AS volume_cm3, round(d, 6) AS diameter_mm, round(100.0*n/greatest(o, 1), 6) AS coverage_pct, CASE WHEN oz IS NULL THEN 'unknown' WHEN cz < oz THEN 'right_lobe' ELSE 'left_lobe' END AS subregion, {_STAGED.format(d='d', v='cm3')} AS t_stage FROM w JOIN s USING (case_id) JOIN k USING (case_id)")  # fmt: skip
def tumour_metadata(spark, sf_dir):
    return _rounded(phenotype.tumour_metadata(fixture.voxels(spark, sf_dir), fixture.cases(spark, sf_dir)))


def _phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, cases = binned(spark, sf_dir), fixture.cases(spark, sf_dir)
    counts = staged(features.label_counts(labelled))
    chosen = phenotype.select_tumour_nodes(counts)
    far = staged(phenotype.min_distance_per_label(labelled, cases, chosen))
    return staged(phenotype.phenotypes(staged(features.node_features(labelled, "v", cases)), chosen, far, cases))


_PHENO = (
    _BINNED + _NODES + _COUNTS + ",\nchosen AS (SELECT case_id, label, n, row_number() OVER (PARTITION BY case_id ORDER BY label) - 1 AS tumor_idx FROM counts WHERE n_tumour / n > 0.1), "
    "oth AS (SELECT c.case_id, CAST(sum(CASE WHEN k.label IS NULL THEN c.n ELSE 0 END) AS BIGINT) AS others FROM counts c LEFT JOIN chosen k USING (case_id, label) GROUP BY c.case_id), "
    "o AS (SELECT case_id, x, y, z FROM voxels WHERE seg = 1), "
    "far AS (SELECT v.case_id, v.label, min(sqrt((v.x-o.x)*(v.x-o.x)*sx*sx + (v.y-o.y)*(v.y-o.y)*sy*sy + (v.z-o.z)*(v.z-o.z)*sz*sz)) AS d FROM binned v JOIN chosen USING (case_id, label) JOIN cases USING (case_id) JOIN o ON v.case_id = o.case_id GROUP BY v.case_id, v.label), "
    "ph0 AS (SELECT k.case_id, dataset, tumor_idx, k.label AS supernode_id, k.n*sx*sy*sz/1000.0 AS volume_cm3, 2.0*pow(3.0*k.n*sx*sy*sz/(4.0*pi()), 1.0/3.0) AS diameter_mm, 100.0*k.n/greatest(others + k.n, 1) AS coverage_pct, compactness, elongation, "
    "CASE WHEN dataset = 'LiTS' THEN CASE WHEN cz < 8 THEN 'right_lobe' ELSE 'left_lobe' END WHEN cz/16 < 0.33 THEN 'pancreatic_tail' WHEN cz/16 < 0.66 THEN 'pancreatic_body' ELSE 'pancreatic_head' END AS subregion, "
    f"{_MORPHOLOGY} AS morphology, coalesce(d, 0) AS distance_to_organ_mm, mean_intensity, intensity_std FROM chosen k JOIN oth USING (case_id) JOIN nodes USING (case_id, label) JOIN cases USING (case_id) LEFT JOIN far USING (case_id, label)), "
    f"ph AS (SELECT *, {_STAGED.format(d='diameter_mm', v='volume_cm3')} AS t_stage, 'case_' || case_id || '_tumor_' || tumor_idx AS source FROM ph0)"
)
_PHENO_ROWS = "case_id, dataset, CAST(tumor_idx AS INT) AS tumor_idx, supernode_id, round(volume_cm3, 6) AS volume_cm3, round(diameter_mm, 6) AS diameter_mm, round(coverage_pct, 6) AS coverage_pct, compactness, round(elongation, 4) AS elongation, subregion, morphology, t_stage, round(distance_to_organ_mm, 6) AS distance_to_organ_mm, round(mean_intensity, 6) AS mean_intensity, round(intensity_std, 6) AS intensity_std"


@query(_PHENO + f"\nSELECT {_PHENO_ROWS} FROM ph")
def phenotypes(spark, sf_dir):
    p = _phenotypes(spark, sf_dir)
    return p.select(*(F.col(c) if t != "double" or c == "compactness" else _r(c, 4 if c == "elongation" else 6) for c, t in p.dtypes))


_TARGETS = (
    ("CASE WHEN dataset = 'LiTS' THEN 'organ_liver' ELSE 'organ_pancreas' END", "part_of"),
    ("CASE WHEN dataset = 'LiTS' THEN 'disease_hepatocellular_carcinoma' ELSE 'disease_pancreatic_adenocarcinoma' END", "suggestive_of"),
    ("'anatomy_' || subregion", "located_in"),
    ("'stage_' || lower(t_stage)", "has_stage"),
    *((f"source || '_feat_{c}'", "has_feature") for c in phenotype.KG_FEATURES),
    ("'obs_' || morphology", "has_morphology"),
)
_KG_EDGES = ",\nkge AS (" + " UNION ALL ".join(f"SELECT case_id, source, {t} AS target, '{r}' AS relation FROM ph" for t, r in _TARGETS) + ")"


@query(_PHENO + _KG_EDGES + "\nSELECT * FROM kge")
def kg_edges(spark, sf_dir):
    return phenotype.kg_edges(_phenotypes(spark, sf_dir))


_EMPTY = {"value": "CAST(NULL AS DOUBLE)", "term": "CAST(NULL AS VARCHAR)", "dataset": "CAST(NULL AS VARCHAR)", "case_id": "CAST(NULL AS BIGINT)", "supernode_id": "CAST(NULL AS BIGINT)"} | {c: "CAST(NULL AS DOUBLE)" for c in ("compactness", "elongation", "mean_intensity", "intensity_std")}


def _kg_part(source: str, id_: str, kind: str, name: str, seq: str, **more: str) -> str:
    rest = ", ".join(f"{more.get(c, e)} AS {c}" for c, e in _EMPTY.items())
    return f"SELECT {id_} AS id, '{kind}' AS type, {name} AS name, case_id AS of_case, {seq} AS seq, {rest} FROM {source}"


_KG_NODES = ",\nkgn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY of_case, seq) AS k FROM (" + " UNION ALL ".join(
    [
        _kg_part("cases", "CASE WHEN dataset = 'LiTS' THEN 'organ_liver' ELSE 'organ_pancreas' END", "Organ", "CASE WHEN dataset = 'LiTS' THEN 'liver' ELSE 'pancreas' END", "0"),
        _kg_part("cases", "CASE WHEN dataset = 'LiTS' THEN 'disease_hepatocellular_carcinoma' ELSE 'disease_pancreatic_adenocarcinoma' END", "Disease", "CASE WHEN dataset = 'LiTS' THEN 'hepatocellular_carcinoma' ELSE 'pancreatic_adenocarcinoma' END", "1"),
        _kg_part("ph", "source", "Tumor", "'tumor_' || tumor_idx", "20 * tumor_idx + 2", **{c: c for c in ("dataset", "case_id", "supernode_id", "compactness", "elongation", "mean_intensity", "intensity_std")}),
        _kg_part("ph", "'anatomy_' || subregion", "Anatomy", "subregion", "20 * tumor_idx + 3"),
        _kg_part("ph", "'stage_' || lower(t_stage)", "Stage", "t_stage", "20 * tumor_idx + 4"),
        *(_kg_part("ph", f"source || '_feat_{c}'", "Feature", f"'{c}'", f"20 * tumor_idx + {5 + k}", value=c) for k, c in enumerate(phenotype.KG_FEATURES)),
        _kg_part("ph", "'obs_' || morphology", "Observation", "morphology", "20 * tumor_idx + 13", term="morphology"),
    ]
) + ") q) r WHERE k = 1)"
_KG_DIGITS = {"elongation": 4, "mean_intensity": 6, "intensity_std": 6}
_KG_ROUND = ", ".join(f"round({c}, {n}) AS {c}" for c, n in _KG_DIGITS.items())


def _kg_nodes(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    return phenotype.dedupe_nodes(phenotype.kg_nodes(found, fixture.cases(spark, sf_dir)))


@query(_PHENO + _KG_NODES + f"\nSELECT id, of_case, type, name, 'CT' AS modality, CASE WHEN name = 'elongation' THEN round(value, 4) WHEN name = 'compactness' THEN round(ln(value), 6) ELSE round(value, 6) END AS value, term, dataset, case_id, supernode_id, compactness, {_KG_ROUND} FROM kgn")
def kg_nodes(spark, sf_dir):
    """All nodes; compactness values, which are huge without a border, as logarithms."""
    n = _kg_nodes(spark, sf_dir, _phenotypes(spark, sf_dir))
    value = F.when(F.col("name") == "elongation", F.round("value", 4)).when(F.col("name") == "compactness", F.round(F.log("value"), 6)).otherwise(F.round("value", 6)).alias("value")
    props = [F.col("props")["compactness"].alias("compactness"), *(F.round(F.col("props")[c], n).alias(c) for c, n in _KG_DIGITS.items())]
    return n.select("id", "of_case", "type", "name", "modality", value, "term", "dataset", "case_id", "supernode_id", *props)


@query(_PHENO + _KG_NODES + _KG_EDGES + "\nSELECT 'node' AS what, type AS name, count(*) AS n FROM kgn GROUP BY type UNION ALL SELECT 'edge', relation, count(*) FROM kge GROUP BY relation")
def kg_stats(spark, sf_dir):
    p = _phenotypes(spark, sf_dir)
    return phenotype.kg_stats(_kg_nodes(spark, sf_dir, p), phenotype.kg_edges(p))


@query(_PHENO + _KG_NODES.replace("PARTITION BY id", "PARTITION BY of_case, id") + "\nSELECT of_case, id, type, name FROM kgn")
def kg_case_nodes(spark, sf_dir):
    """Nodes of each case's own graph: an id that several cases share is in each of them."""
    nodes = phenotype.kg_nodes(_phenotypes(spark, sf_dir), fixture.cases(spark, sf_dir))
    return phenotype.dedupe_nodes(nodes, per_case=True).select("of_case", "id", "type", "name")


@query(_PHENO + _KG_EDGES + "\nSELECT * FROM kge")
def kg_all_edges(spark, sf_dir):
    """``kg_edges`` under its former name."""
    return kg_edges(spark, sf_dir)


@query(ORACLES["kg_stats"].removeprefix("WITH RECURSIVE " + fixture.SQL))
def kg_all_stats(spark, sf_dir):
    """``kg_stats`` under its former name."""
    return kg_stats(spark, sf_dir)


_CATEGORIES = ("morphology", "t_stage", "subregion", "dataset", "supernode_id")


@query(_PHENO + "\n" + " UNION ALL ".join(f"SELECT '{c}' AS category, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM ph GROUP BY ALL" for c in _CATEGORIES))
def categories(spark, sf_dir):
    return report.category_distribution(_phenotypes(spark, sf_dir), _CATEGORIES)


# reference rows as files: a little off the true masks, so that comparisons have something to find


_REF = ",\nref AS (SELECT case_id, CAST(tumour + case_id % 5 AS BIGINT) AS tumour_voxels, CAST(organ - case_id % 7 AS BIGINT) AS organ_voxels, (case_id % 40) / 2.0 AS coverage_pct, (case_id % 4) + 0.5 AS distance_voxels FROM (SELECT case_id, sum(CASE WHEN seg=2 THEN 1 ELSE 0 END) AS tumour, sum(CASE WHEN seg=1 THEN 1 ELSE 0 END) AS organ FROM voxels GROUP BY case_id) q WHERE tumour > 0)"


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference rows, written as a CSV file in the shared folder and read back by the reader of such files."""
    s, c = volumes.case_summary(fixture.voxels(spark, sf_dir)).where("tumour > 0"), F.col("case_id")
    path = f"{shared_dir(spark)}/reference-{uuid.uuid4().hex}"
    rows = s.select(F.format_string("scan_%d.nii.gz", c).alias("CT Scan"), (F.col("tumour") + c % 5).alias("Tumor Volume"), (F.col("organ") - c % 7).alias("Organ Volume"), (c % 40 / 2.0).alias("Tumor Coverage (%)"), (c % 4 + 0.5).alias("Distance (voxels)"), F.lit("low").alias("Risk_GT"), F.lit("none").alias("Phenotype_GT"))
    volumes.write_metadata_csv(rows, path)
    return volumes.read_reference_csv(spark, path)


@query(_REF + "\nSELECT case_id, tumour_voxels, organ_voxels, coverage_pct, CAST(distance_voxels AS DOUBLE) AS distance_voxels, 'low' AS risk_gt, 'none' AS phenotype_gt FROM ref")
def reference_rows(spark, sf_dir):
    return reference(spark, sf_dir)


def _off(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN abs({a} - {b}) / {b} END"


_COMPARED = (("volume_cm3", "v", "tumour_cm3"), ("diameter_mm", "di", "gt.diameter_mm"), ("coverage_pct", "c", "gt.coverage_pct"), ("distance_to_organ_mm", "m", "gt.distance_to_organ_mm"))


@query(_PHENO.replace("far AS (", "pfar AS (").replace("LEFT JOIN far", "LEFT JOIN pfar").replace("o AS (SELECT case_id, x, y, z FROM voxels WHERE seg = 1), ", "").replace("JOIN o ON", "JOIN (SELECT case_id, x, y, z FROM voxels WHERE seg = 1) o ON") + _GT + ",\nds AS (SELECT case_id, sum(volume_cm3) AS v, sum(coverage_pct) AS c, min(distance_to_organ_mm) AS m, 2.0*pow(3.0*sum(volume_cm3)*1000.0/(4.0*pi()), 1.0/3.0) AS di FROM ph GROUP BY case_id)\n" + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({_off(a, b)}), 6) AS mean_error, count({_off(a, b)}) AS n FROM gt JOIN ds USING (case_id)" for f, a, b in _COMPARED))
def compare_case(spark, sf_dir):
    gt = phenotype.gt_phenotypes(fixture.voxels(spark, sf_dir), fixture.cases(spark, sf_dir))
    return _rounded(report.compare_case(gt, _phenotypes(spark, sf_dir)))


_CSV_NUMBERS = ("volume_cm3", "diameter_mm", "coverage_pct", "distance_to_organ_mm", "elongation")


@query(_PHENO + _REF + ",\nds AS (SELECT case_id, sum(volume_cm3) AS volume_cm3, max(diameter_mm) AS diameter_mm, sum(coverage_pct) AS coverage_pct, min(distance_to_organ_mm) AS distance_to_organ_mm, avg(compactness) AS compactness, avg(elongation) AS elongation, arg_min(morphology, tumor_idx) AS morphology, arg_min(t_stage, tumor_idx) AS t_stage, arg_min(subregion, tumor_idx) AS subregion FROM ph GROUP BY case_id), "
       "rs AS (SELECT case_id, tumour_voxels*sx*sy*sz/1000.0 AS ref_volume_cm3, 2.0*pow(3.0*greatest(tumour_voxels*sx*sy*sz/1000.0, 0.001)*1000.0/(4.0*pi()), 1.0/3.0) AS ref_diameter_mm, coverage_pct AS ref_coverage_pct, distance_voxels*sx AS ref_distance_to_organ_mm FROM ref JOIN cases USING (case_id)), "
       f"j AS (SELECT rs.*, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in _CSV_NUMBERS)}, coalesce(compactness, 0.0) AS compactness, {', '.join(f"coalesce({c}, 'N/A') AS {c}" for c in ('morphology', 't_stage', 'subregion'))} FROM rs LEFT JOIN ds USING (case_id))\n"
       f"SELECT case_id, {', '.join(f'round(ref_{c}, 6) AS ref_{c}' for c in _CSV_NUMBERS[:4])}, {', '.join(f'round({c}, {4 if c == "elongation" else 6}) AS {c}' for c in _CSV_NUMBERS)}, compactness, morphology, t_stage, subregion, {', '.join(f"round(100.0 * {_off(c, f'ref_{c}')}, 6) AS {c}_error_pct" for c in _CSV_NUMBERS[:4])} FROM j")  # fmt: skip
def compare_case_csv(spark, sf_dir):
    r = report.compare_case_csv(reference(spark, sf_dir), _phenotypes(spark, sf_dir), fixture.cases(spark, sf_dir))
    return r.select(*(F.col(c) if t != "double" or c == "compactness" else _r(c, 4 if c == "elongation" else 6) for c, t in r.dtypes))


@query(_PHENO + _REF + "\nSELECT ref_tumours, round(ref_voxels, 4) AS ref_voxels, round(ref_coverage_pct, 4) AS ref_coverage_pct, round(ref_distance, 4) AS ref_distance, tumours, round(mean_mm3, 4) AS mean_mm3, round(mean_coverage_pct, 4) AS mean_coverage_pct, round(mean_distance_mm, 4) AS mean_distance_mm, round(ln(mean_compactness), 4) AS mean_compactness, round(mean_elongation, 4) AS mean_elongation, round(tumours / greatest(ref_tumours, 1), 4) AS tumour_ratio FROM (SELECT count(*) AS ref_tumours, avg(tumour_voxels) AS ref_voxels, avg(coverage_pct) AS ref_coverage_pct, avg(distance_voxels) AS ref_distance FROM ref) a, (SELECT count(*) AS tumours, avg(volume_cm3) * 1000 AS mean_mm3, avg(coverage_pct) AS mean_coverage_pct, avg(distance_to_organ_mm) AS mean_distance_mm, avg(compactness) AS mean_compactness, avg(elongation) AS mean_elongation FROM ph) b")
def compare_means(spark, sf_dir):
    """Means of both sides; the compactness as its logarithm."""
    m = report.compare_means(reference(spark, sf_dir), _phenotypes(spark, sf_dir))
    return _rounded(m.withColumn("mean_compactness", F.log("mean_compactness")), 4)


@query(_REF + "\nSELECT case_id, CAST(sum(CASE WHEN seg=2 THEN 1 ELSE 0 END) AS BIGINT) AS tumour, CAST(sum(CASE WHEN seg=1 THEN 1 ELSE 0 END) AS BIGINT) AS organ, round(100.0*sum(CASE WHEN seg=2 THEN 1 ELSE 0 END)/greatest(sum(CASE WHEN seg=1 THEN 1 ELSE 0 END), 1), 6) AS coverage, any_value(tumour_voxels) AS tumour_voxels, any_value(organ_voxels) AS organ_voxels, any_value(coverage_pct) AS coverage_pct, CAST(any_value(distance_voxels) AS DOUBLE) AS distance_voxels FROM voxels JOIN ref USING (case_id) GROUP BY case_id")
def derived_vs_csv_volumes(spark, sf_dir):
    r = reference(spark, sf_dir).drop("risk_gt", "phenotype_gt")
    return _rounded(report.derived_vs_csv_volumes(fixture.voxels(spark, sf_dir), r))


_PATIENT = _BINNED + _NODES + _COUNTS + ",\nkinds AS (SELECT c.case_id, CASE WHEN n_tumour / n > 0.1 THEN 'tumour' WHEN (n_organ - n_tumour) / n > 0.3 THEN 'organ' END AS kind, volume, cx, cy, cz FROM counts c JOIN nodes USING (case_id, label)), pts AS (SELECT case_id, kind, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS regions, sum(cx*sx*volume)/sum(volume) AS px, sum(cy*sy*volume)/sum(volume) AS py, sum(cz*sz*volume)/sum(volume) AS pz FROM kinds JOIN cases USING (case_id) WHERE kind IS NOT NULL GROUP BY case_id, kind)"


def _patients(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labelled, cases = binned(spark, sf_dir), fixture.cases(spark, sf_dir)
    return phenotype.patient_graph(staged(features.label_counts(labelled)), staged(features.node_features(labelled, "v", cases)), cases)


@query(_PATIENT + "\nSELECT case_id, kind, volume, regions, round(px, 6) AS cx, round(py, 6) AS cy, round(pz, 6) AS cz FROM pts")
def patient_nodes(spark, sf_dir):
    return _rounded(_patients(spark, sf_dir)[0])


@query(_PATIENT + "\nSELECT a.case_id, a.kind AS source, b.kind AS target, round(sqrt((a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py) + (a.pz-b.pz)*(a.pz-b.pz)), 6) AS distance_mm, round(100.0*b.volume/greatest(a.volume + b.volume, 1), 6) AS coverage_pct FROM pts a JOIN pts b ON a.case_id = b.case_id AND a.kind = 'organ' AND b.kind = 'tumour'")
def patient_graph(spark, sf_dir):
    return _rounded(_patients(spark, sf_dir)[1])


# classification and search


@query(_BINNED + _COUNTS + ",\nth(t) AS (VALUES (0.01), (0.05), (0.1), (0.2), (0.4)), s AS (SELECT t, sum(n_tumour) AS g, sum(CASE WHEN n_tumour / n >= t THEN n_tumour ELSE 0 END) AS b, sum(CASE WHEN n_tumour / n >= t THEN n ELSE 0 END) AS p FROM counts, th GROUP BY t), d AS (SELECT CAST(t AS DOUBLE) AS threshold, 2.0*b/(g+p+1e-8) AS dice, b/g AS recall, CASE WHEN p > 0 THEN b/p ELSE 0.0 END AS precision FROM s)\nSELECT threshold, round(dice, 6) AS dice, round(recall, 6) AS recall, round(precision, 6) AS precision, row_number() OVER (ORDER BY dice DESC, threshold) = 1 AS best FROM d")
def threshold_sweep(spark, sf_dir):
    c = staged(features.label_counts(binned(spark, sf_dir)))
    scored = c.select("case_id", "label", (F.col("n_tumour") / F.col("n")).alias("p"))
    return _rounded(learn.threshold_sweep(scored, c, [0.01, 0.05, 0.1, 0.2, 0.4]))


@query(_BINNED + _COUNTS + "\nSELECT CAST(sum(CASE WHEN n_tumour / n > 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS positive, CAST(sum(CASE WHEN n_tumour / n > 0.1 THEN 0 ELSE 1 END) AS BIGINT) AS negative, round(sum(CASE WHEN n_tumour / n > 0.1 THEN 0 ELSE 1 END) / greatest(sum(CASE WHEN n_tumour / n > 0.1 THEN 1 ELSE 0 END), 1), 6) AS ratio FROM counts")
def class_balance(spark, sf_dir):
    return _rounded(learn.class_balance(features.node_target(features.label_counts(binned(spark, sf_dir)))))


@query(_BINNED + _FACES + ",\nnv AS (SELECT case_id, label, count(*) / 4096.0 AS a, avg(v) AS b FROM binned GROUP BY case_id, label), e AS (SELECT case_id, lo AS s, hi AS d FROM faces UNION ALL SELECT case_id, hi, lo FROM faces)\nSELECT e.case_id, e.d AS label, round(sum(greatest(a, 0.0)), 6) AS m0, round(sum(greatest(b, 0.0)), 6) AS m1 FROM e JOIN nv ON e.case_id = nv.case_id AND e.s = nv.label GROUP BY e.case_id, e.d")
def message_sums(spark, sf_dir):
    labelled = binned(spark, sf_dir)
    nodes = labelled.groupBy("case_id", "label").agg(F.array(F.count("*") / 4096.0, F.avg("v")).alias("features"))
    indexed = staged(E.dense_index(nodes))
    e = E.bidirectional(E.shared_faces(labelled))
    s, d = (indexed.select("case_id", F.col("label").alias(c), F.col("idx").alias(f"{c}_idx")) for c in ("src", "dst"))
    links = e.join(s, ["case_id", "src"]).join(d, ["case_id", "dst"]).select("case_id", F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"))
    m = learn.message_aggregate(indexed, links).join(indexed.select("case_id", "idx", "label"), ["case_id", "idx"])
    return _rounded(m.select("case_id", "label", F.col("message")[0].alias("m0"), F.col("message")[1].alias("m1")))


@query(_BINNED + "\nSELECT round(quantile_cont(v, 0.01), 6) AS low, round(quantile_cont(v, 0.99), 6) AS high FROM binned")
def intensity_range(spark, sf_dir):
    return _rounded(search.intensity_range(binned(spark, sf_dir), "v"))


@query(_BINNED + _COUNTS + _FACES + ",\nb(beta_min) AS (VALUES (1), (50), (200), (1000)), p AS (SELECT beta_min, case_id, sum(CASE WHEN n >= beta_min THEN 1 ELSE 0 END) AS k, sum(CASE WHEN n >= beta_min AND n_tumour / n > 0.1 THEN 1 ELSE 0 END) AS t, sum(CASE WHEN n >= beta_min AND n_tumour / n > 0.1 THEN n_tumour ELSE 0 END) AS both_, sum(CASE WHEN n >= beta_min AND n_tumour / n > 0.1 THEN n ELSE 0 END) AS pr, sum(n_tumour) AS g, sum(CASE WHEN n < beta_min THEN n ELSE 0 END) AS gone, sum(n) AS nv FROM counts, b GROUP BY beta_min, case_id), ed AS (SELECT beta_min, count(*) AS edges FROM faces f JOIN counts x ON f.case_id = x.case_id AND f.lo = x.label JOIN counts y ON f.case_id = y.case_id AND f.hi = y.label JOIN b ON least(x.n, y.n) >= beta_min GROUP BY beta_min), r AS (SELECT CAST(beta_min AS INT) AS beta_min, CAST(sum(k) AS BIGINT) AS supernodes, CAST(sum(t) AS BIGINT) AS tumour_supernodes, round(avg(CASE WHEN g = 0 THEN CASE WHEN pr = 0 THEN 1.0 ELSE 0.0 END ELSE 2.0*both_/(g+pr+1e-8) END), 6) AS oracle_dice, round(100.0*sum(both_)/greatest(sum(g), 1), 6) AS capture_pct, round(100.0*sum(gone)/sum(nv), 6) AS deleted_pct FROM p GROUP BY beta_min)\nSELECT r.*, coalesce(edges, 0) AS edges FROM r LEFT JOIN ed ON r.beta_min = ed.beta_min")
def beta_sweep(spark, sf_dir):
    labelled = binned(spark, sf_dir)
    return _rounded(search.beta_sweep(staged(features.label_counts(labelled)), [1, 50, 200, 1000], faces=staged(E.shared_faces(labelled))))


_HASH = "md5(CAST(case_id AS VARCHAR) || ':42')"


@query(f",\nn AS (SELECT count(*) AS n FROM cases), r AS (SELECT case_id, row_number() OVER (ORDER BY {_HASH}, case_id) AS r FROM cases), few AS (SELECT case_id FROM (SELECT case_id, sum(CASE WHEN seg = 2 THEN 1 ELSE 0 END) AS t FROM voxels GROUP BY case_id) q WHERE t > 20 ORDER BY {_HASH}, case_id LIMIT 5)\nSELECT case_id, CASE WHEN r <= greatest(3, floor(n * 0.70)) THEN 'train' WHEN r <= greatest(3, floor(n * 0.70)) + greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'test' END AS split, case_id IN (SELECT case_id FROM few) AS few_shot FROM r, n")
def split_cases(spark, sf_dir):
    """A split of all cases, and which of them a few-shot search would take."""
    few = volumes.pick_few_shot(fixture.voxels(spark, sf_dir), 5, 20).withColumn("few_shot", F.lit(True))
    return volumes.split_cases(fixture.cases(spark, sf_dir)).join(few, "case_id", "left").withColumn("few_shot", F.coalesce("few_shot", F.lit(False)))


@query(f"\nSELECT case_id FROM cases ORDER BY {_HASH}, case_id LIMIT 20")
def sampled_cases(spark, sf_dir):
    return volumes.sample_cases(fixture.cases(spark, sf_dir), 20)


@query(_GT + "\nSELECT CAST(case_id AS VARCHAR) AS case_id, CAST(tumour_voxels AS VARCHAR) AS tumour_voxels, CAST(CAST(round(diameter_mm, 4) AS DOUBLE) AS VARCHAR) AS diameter_mm FROM gt")
def metadata_csv(spark, sf_dir):
    """Measures written as a CSV file with a header and read back as text."""
    path = f"{shared_dir(spark)}/metadata-{uuid.uuid4().hex}"
    volumes.write_metadata_csv(phenotype.gt_phenotypes(fixture.voxels(spark, sf_dir), fixture.cases(spark, sf_dir)).select("case_id", "tumour_voxels", "diameter_mm"), path)
    return spark.read.option("header", "true").csv(path)


@query(_BINNED + _COUNTS + "\nSELECT case_id, label, n, n_organ, n_tumour FROM counts")
def results_json(spark, sf_dir):
    """Region counts written as JSON by case and read back."""
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    volumes.write_results_json(features.label_counts(binned(spark, sf_dir)), path, by_case=True)
    return spark.read.schema("label bigint, n bigint, n_organ bigint, n_tumour bigint, case_id bigint").json(path).select("case_id", "label", "n", "n_organ", "n_tumour")


@query(_BINNED + "\nSELECT case_id, label FROM binned GROUP BY case_id, label HAVING stddev_pop(v) > 0.4 * 0.05 AND count(*) > 30")
def heterogeneous_regions(spark, sf_dir):
    return contract.heterogeneous_regions(binned(spark, sf_dir), "v", 0.05)


@query(_BINNED + _COUNTS + "\nSELECT 1.0 :: DOUBLE AS w0, round(least(sqrt((count(*) - sum(y)) / sum(y)), 30.0), 6) AS w1, round((count(*) - sum(y)) / sum(y), 6) AS raw FROM (SELECT CASE WHEN n_tumour / n > 0.1 THEN 1 ELSE 0 END AS y FROM counts) q")
def class_weights(spark, sf_dir):
    y = staged(features.node_target(features.label_counts(binned(spark, sf_dir))))
    w0, w1 = learn.class_weights(y)
    return spark.createDataFrame([(w0, round(w1, 6), round(learn.class_weights(y, "raw")[1], 6))], "w0 double, w1 double, raw double")


_HISTOGRAM = features.NODE_FEATURES


@query(_BINNED + _NODES + _COUNTS + ",\nlong AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN n_tumour / n > 0.1 THEN 1 ELSE 0 END AS y, CAST({c} AS DOUBLE) AS v FROM nodes JOIN counts USING (case_id, label)" for c in _HISTOGRAM) + "), sp AS (SELECT feature, min(v) AS lo, (max(v) - min(v)) / 30 AS w FROM long GROUP BY feature), "
       "b AS (SELECT feature, y, w, CASE WHEN w > 0 THEN least(floor((v - lo) / w), 29) ELSE 0 END AS bin, count(*) AS n FROM long JOIN sp USING (feature) GROUP BY ALL)\nSELECT feature, y, CAST(bin AS INT) AS bin, n, round(CASE WHEN w > 0 THEN n / (sum(n) OVER (PARTITION BY feature, y) * w) ELSE 0.0 END, 6) AS density FROM b")  # fmt: skip
def feature_distribution(spark, sf_dir):
    labelled = binned(spark, sf_dir)
    nodes, counts = staged(features.node_features(labelled, "v", fixture.cases(spark, sf_dir))), staged(features.label_counts(labelled))
    marked = staged(nodes.join(features.node_target(counts), ["case_id", "label"]))
    return _rounded(features.feature_distribution(marked, _HISTOGRAM, 30))


_DIMS = range(len(features.NODE_FEATURES))


def _hop(source: str, out: str) -> str:
    sums = ", ".join(f"coalesce(sum(greatest(s.f{k}, 0.0)), 0.0) AS f{k}" for k in _DIMS)
    return f",\n{out} AS (SELECT d.case_id, d.idx, {sums} FROM idx d LEFT JOIN both_ b ON d.case_id = b.case_id AND d.label = b.dst LEFT JOIN {source} s ON s.case_id = b.case_id AND s.label_ = b.src GROUP BY d.case_id, d.idx), {out}l AS (SELECT {out}.*, label AS label_ FROM {out} JOIN idx USING (case_id, idx))"


@query(_BINNED + _NODES + _FACES + _COUNTS + ",\nlim AS (SELECT case_id, " + ", ".join(f"min({c}) AS lo{k}, max({c}) AS hi{k}" for k, c in enumerate(features.NODE_FEATURES)) + " FROM nodes GROUP BY case_id), "
       "idx AS (SELECT case_id, label, row_number() OVER (PARTITION BY case_id ORDER BY label) - 1 AS idx FROM nodes), "
       "h0l AS (SELECT case_id, idx, label AS label_, " + ", ".join(f"CASE WHEN hi{k} - lo{k} > 1e-8 THEN ({c} - lo{k}) / (hi{k} - lo{k}) ELSE {c} END AS f{k}" for k, c in enumerate(features.NODE_FEATURES)) + " FROM nodes JOIN lim USING (case_id) JOIN idx USING (case_id, label)), "
       "both_ AS (SELECT case_id, lo AS src, hi AS dst FROM faces UNION ALL SELECT case_id, hi, lo FROM faces)" + _hop("h0l", "h1") + _hop("h1l", "h2")
       + "\nSELECT h0l.case_id, h0l.idx, c.label, CASE WHEN n_tumour / n > 0.1 THEN 1 ELSE 0 END AS y, " + ", ".join(f"round({h}.f{k}, 4) AS {h}_{k}" for h in ("h0l", "h1", "h2") for k in _DIMS) + " FROM counts c JOIN h0l ON c.case_id = h0l.case_id AND c.label = h0l.label_ JOIN h1 ON h1.case_id = h0l.case_id AND h1.idx = h0l.idx JOIN h2 ON h2.case_id = h0l.case_id AND h2.idx = h0l.idx")
def khop_features(spark, sf_dir):
    """Scaled features of each region, and the sums over its neighbours in one and two steps."""
    labelled, cases = binned(spark, sf_dir), fixture.cases(spark, sf_dir)
    rows = staged(features.region_rows(labelled, "v"))
    nodes, faces = staged(features.nodes_of_rows(rows, cases)), staged(features.faces_of_rows(rows))
    graph, links = features.assemble_graph(nodes, features.edge_features(faces, nodes, faces, cases), features.node_target(features.counts_of_rows(rows)))
    hops = learn.khop_features(staged(graph), staged(links.select("case_id", "src", "dst")), 2)
    return hops.select("case_id", "idx", "label", "y", *(F.round(F.col("features")[7 * h + k], 4).alias(f"{n}_{k}") for h, n in enumerate(("h0l", "h1", "h2")) for k in _DIMS))


@query(_BINNED + ",\nlim AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM binned), g AS (SELECT a.range AS i, b.range AS j, c.range AS k, lo, hi, hi - lo AS r FROM range(16) a, range(8) b, range(8) c, lim)\nSELECT CAST(64 * i + 8 * j + k AS INT) AS config_id, round(0.02 * r + i * ((0.35 * r - 0.02 * r) / 15), 6) AS psi, round(0.05 * r + j * ((0.5 * r - 0.05 * r) / 7), 6) AS alpha, CAST(trunc(pow(10.0, 1.0 + k * (2.5 / 7))) AS INT) AS beta_min, 500000 AS beta_max, round(lo, 6) AS m_min, round(hi, 6) AS m_max FROM g")
def param_grid(spark, sf_dir):
    """The 1024 configurations of the default grid over the intensities' range."""
    r = search.intensity_range(binned(spark, sf_dir), "v").first()
    return _rounded(search.param_grid(spark, r.low, r.high))


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    voxels = binned(spark, sf_dir).drop("label")
    r = search.intensity_range(voxels, "v").first()
    configs = staged(search.param_grid(spark, r.low, r.high))
    return search.grid_search(voxels, "v", configs), configs


@query(None)
def grid_search(spark, sf_dir):
    """All 1024 configurations of the default grid, by the mean surface Dice over all cases."""
    return _rounded(search.search_log(*_searched(spark, sf_dir)).drop("per_case"))


@query(None)
def best_config(spark, sf_dir):
    """The first of the 1024 configurations of the default grid with the highest mean surface Dice."""
    return _rounded(search.best_config(search.search_log(*_searched(spark, sf_dir))).drop("per_case"))


@query(None)
def random_search(spark, sf_dir):
    """Scores of configurations drawn at random, over all cases; the best five of fifty."""
    configs = staged(search.random_search(spark, 50))
    scores = search.grid_search(binned(spark, sf_dir).drop("label"), "v", configs, measure="volume")
    return _rounded(search.top_configs(search.search_log(scores, configs, penalty=True).drop("per_case"), 5))


@query(None)
def window_sweep(spark, sf_dir):
    """Mean oracle Dice of quantised components in all intensity windows."""
    return _rounded(search.window_sweep(fixture.voxels(spark, sf_dir), scalars.WINDOWS))


@query(None)
def config_sweep(spark, sf_dir):
    """The diagnosis' six configurations over all cases with a tumour."""
    return _rounded(search.config_sweep(binned(spark, sf_dir).drop("label"), "v"))


STRATEGIES = {
    "quantized": {"method": "quantized", "beta_min": 5},
    "adaptive": {"method": "adaptive", "psi": 0.12, "alpha": 0.12},
    "anchored": {"method": "anchored", "psi": 0.05, "alpha": 0.10},
    "capped and merged": {"method": "anchored_capped", "psi": 0.05, "alpha": 0.10, "beta_max": 2000},
    "no such method": {"method": "kmeans"},
    "no lattice": {"method": "adaptive", "stride": 0},
}


@query(None)
def strategy_comparison(spark, sf_dir):
    """Every contraction on every case; a method that fails leaves a row that says so."""
    return _rounded(search.strategy_comparison(binned(spark, sf_dir).drop("label"), "v", STRATEGIES))


# contraction and composed jobs, over all voxels


def _slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and values: contractions carry along and write whatever columns they are given."""
    return binned(spark, sf_dir).select("case_id", *stencil.AXES, "lin", "v")


def _sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("case_id", "label").agg(F.count("*").alias("n"), F.sum("lin").alias("places"))


@query(None)
def quantized_components(spark, sf_dir):
    return _sizes(contract.quantized_components(_slim(spark, sf_dir), "v", BINS))


@query(None)
def marker_watershed(spark, sf_dir):
    """Sizes of the basins that grow from a lattice of markers."""
    flat = staged(stencil.gradient_magnitude(_slim(spark, sf_dir), "v"))
    return _sizes(contract.marker_watershed(flat, "gradient", stencil.lattice_markers(flat, 5)))


@query(None)
def refined_regions(spark, sf_dir):
    """A finer watershed inside the regions whose intensities are mixed."""
    refined = contract.refined_watershed(_slim(spark, sf_dir), "v", 0.05, 8, 12)
    return refined.groupBy("case_id", "mixed", "grown").agg(F.count("*").alias("n"), F.sum("lin").alias("places"))


@query(None)
def split_regions(spark, sf_dir):
    """Regions split by intensity where they are mixed."""
    refined = binned(spark, sf_dir).withColumn("grown", F.expr("1 + x div 8")).withColumn("mixed", F.col("x") < 8).drop("label")
    return _sizes(contract.split_by_intensity(refined, "v", 0.12))


@query(None)
def adaptive_regions(spark, sf_dir):
    return _sizes(contract.adaptive_contract(_slim(spark, sf_dir), "v", 0.12))


@query(None)
def anchored_regions(spark, sf_dir):
    return _sizes(contract.anchored_contract(_slim(spark, sf_dir), "v", 0.05, 0.1))


@query(None)
def capped_regions(spark, sf_dir):
    return _sizes(contract.anchored_contract(_slim(spark, sf_dir), "v", 0.05, 0.1, 300))


@query(None)
def merged_regions(spark, sf_dir):
    return _sizes(contract.merged_contract(_slim(spark, sf_dir), "v", 0.05, 0.1, 300, 2000))


@query(None)
def flagship(spark, sf_dir):
    """Which regions are tumour, how many there are, and how good a mask could be."""
    m = contract.build_minor(binned(spark, sf_dir).drop("label"), "v", "quantized", beta_min=10, bins=BINS)
    counts = staged(features.label_counts(m["labels"]))
    return _rounded(evaluate.oracle(counts).join(evaluate.deletion_loss(counts).select("case_id", "lost", "lost_pct"), "case_id").join(m["stats"].drop("supernodes"), "case_id"))


@query(None)
def group_tumours(spark, sf_dir):
    cases = fixture.cases(spark, sf_dir)
    m = pipelines.measured(fixture.voxels(spark, sf_dir), cases, pipelines.Settings((0, 200), "quantized", beta_min=5))
    return _rounded(phenotype.group_tumours(m["labels"], m["nodes"], m["counts"], cases), 4)


def _job(name: str, doc: str, run: Callable) -> None:
    """Register a composed job over all cases."""

    def job(spark, sf_dir):
        return _rounded(run(fixture.voxels(spark, sf_dir), fixture.cases(spark, sf_dir), spark, sf_dir), 4)

    job.__name__, job.__doc__ = name, doc
    query(None)(job)


_job("quantized_pipeline", "Region classifier over all cases: scores per split and over all.", lambda v, c, *_: pipelines.quantized_pipeline(v, c)["summary"])
_job("pancreas_pipeline", "Minors, classifier, phenotypes and knowledge graph: its nodes and edges by kind.", lambda v, c, *_: pipelines.pancreas_pipeline(v, c)["kg_stats"])
_job("liver_pipeline", "Minors, classifier, grouped tumours: means beside the reference rows.", lambda v, c, spark, sf: pipelines.liver_pipeline(v, c, reference(spark, sf))["means"])
_job("resumable_pipeline", "The resumable job from a store without results: scores per split.", lambda v, c, spark, sf: pipelines.resumable_pipeline(v, c, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")["summary"])
_job("two_stage_pipeline", "Organ regions first, tumours among them: scores per split.", lambda v, c, *_: pipelines.two_stage_pipeline(v, c)["summary"])
_job("context_pipeline", "Eleven features with the organ's context: scores per split.", lambda v, c, *_: pipelines.context_pipeline(v, c)["summary"])
_job("light_deletion_pipeline", "Small tolerance, light deletion: scores per split.", lambda v, c, *_: pipelines.light_deletion_pipeline(v, c)["summary"])
_job("diagnose", "Sweep of the named configurations on sampled cases.", lambda v, c, *_: pipelines.diagnose(v, c)["configs"])
_job("export_masks", "Three-class masks written by case; Dice of both classes.", lambda v, c, spark, sf: pipelines.export_masks(v, c, f"{shared_dir(spark)}/masks-{uuid.uuid4().hex}"))
_job("grouping_report", "Grouped tumours of all cases by category.", lambda v, c, spark, sf: pipelines.grouping_report(v, c, reference(spark, sf))["categories"])
