"""Contraction of voxels into regions, and deletion of regions.

Labels are positive numbers, unique within a case; 0 is a deleted voxel. ``lin`` is below 2^32.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelgraph.functions import scalars
from voxelgraph.operators import features, growth, regions, stencil, whole
from voxelgraph.operators import edges as E
from voxelgraph.operators.whole import FINE
from voxelgraph.session import staged

METHODS = ("adaptive", "quantized", "anchored", "anchored_capped")


def connected(voxels: DataFrame, key: Column, name: str = "label") -> DataFrame:
    """Add the 6-connected component of equal, non-null keys: least ``lin`` in it plus 1; 0 where the key is null."""
    return regions.components(voxels, F.when(key.isNotNull(), F.xxhash64(key)), name)


def quantized_components(voxels: DataFrame, value: str, bins: int) -> DataFrame:
    """Components of voxels in one intensity bin."""
    return _by_extent(voxels, lambda small: whole.contracted(small, value, "quantized", 0.0, 0.0, None, bins, 1), lambda wide: connected(wide, scalars.quantize(F.col(value), bins)))


def marker_watershed(voxels: DataFrame, gradient: str, markers: DataFrame, name: str = "label") -> DataFrame:
    """``voxels`` with ``label``: the volume grown from ``markers`` (``case_id, lin, marker``) by ascending gradient.

    The least spanning forest over face neighbours weighted by the larger gradient, rooted in the markers;
    ties go by the edge's ends, so the result is unique. Voxels with no path to a marker keep label 0.
    """
    marked = voxels.join(markers.select("case_id", "lin", F.col("marker").alias("__marker")), ["case_id", "lin"], "left")
    return regions.spanning_forest(marked, gradient, F.col("__marker"), name).drop("__marker")


def heterogeneous_regions(labelled: DataFrame, value: str, psi: float, least: int = 30) -> DataFrame:
    """``(case_id, label)`` with a population deviation over 0.4 psi and more than ``least`` voxels."""
    stats = labelled.groupBy("case_id", "label").agg(F.count("*").alias("n"), F.stddev_pop(value).alias("s"))
    return stats.where((F.col("s") > 0.4 * psi) & (F.col("n") > least)).select("case_id", "label")


def refine_regions(labelled: DataFrame, gradient: str, flagged: DataFrame, stride: int) -> DataFrame:
    """``labelled`` with ``mixed`` (its region is among ``flagged``) and ``grown``: a finer watershed inside mixed regions.

    Fine markers lie on the lattice of every ``max(3, stride // 3)``-th voxel inside mixed regions; all other
    voxels are markers with the labels they have. A case without fine markers keeps its labels: ``mixed`` is
    false there.
    """
    mixed = labelled.join(flagged.select("case_id", "label", F.lit(True).alias("__mixed")), ["case_id", "label"], "left").withColumn("__mixed", F.coalesce("__mixed", F.lit(False)))
    step = max(3, stride // 3)
    fine = F.col("__mixed") & (F.col("x") % step == 0) & (F.col("y") % step == 0) & (F.col("z") % step == 0)
    finer = mixed.where(fine).select("case_id").distinct().withColumn("__finer", F.lit(True))
    held = mixed.join(finer, "case_id", "left").withColumn("mixed", F.col("__mixed") & F.coalesce("__finer", F.lit(False)))
    # a fine marker is named by its place, which keeps the order of the lattice
    marker = F.when(~F.col("mixed"), F.col("label")).when(fine, F.col("lin") + FINE)
    return regions.spanning_forest(held.withColumn("__marker", marker).drop("__mixed", "__finer"), gradient, F.col("__marker"), "grown").drop("__marker")


def refined_watershed(voxels: DataFrame, value: str, psi: float, first: int, stride: int) -> DataFrame:
    """``voxels`` with ``mixed`` and ``grown``: a watershed from every ``first``-th voxel, and ``refine_regions`` of it."""
    return _by_extent(voxels, lambda small: whole.refined(small, value, psi, first, max(3, stride // 3)), lambda wide: _refined_over_bricks(wide, value, psi, first, stride))


def _refined_over_bricks(voxels: DataFrame, value: str, psi: float, first: int, stride: int) -> DataFrame:
    flat = staged(stencil.gradient_magnitude(voxels, value, "__gradient"))
    coarse = staged(marker_watershed(flat, "__gradient", stencil.lattice_markers(flat, first)))
    return refine_regions(coarse, "__gradient", heterogeneous_regions(coarse, value, psi), stride).select(*voxels.columns, "mixed", "grown")


def split_by_intensity(refined: DataFrame, value: str, psi: float) -> DataFrame:
    """Add ``label``: components of equal (``grown``, intensity bin) where ``mixed``, of equal ``grown`` elsewhere."""
    bin_ = F.when(F.col("mixed"), scalars.quantize(F.col(value), scalars.psi_bins(psi))).otherwise(F.lit(-1))
    return connected(refined, F.struct("grown", bin_.alias("bin")))


def adaptive_contract(voxels: DataFrame, value: str, psi: float, stride: int = 20) -> DataFrame:
    """``voxels`` with ``label``: coarse watershed, refined and split by intensity where a region is mixed.

    Cases in which no region is mixed, or no fine marker falls into one, keep their coarse labels.
    """
    return _by_extent(voxels, lambda small: whole.contracted(small, value, "adaptive", psi, 0.0, None, 0, stride), lambda wide: _adaptive_over_bricks(wide, value, psi, stride))


def _by_extent(voxels: DataFrame, one: Callable[[DataFrame], DataFrame], several: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``one`` of the cases that lie in one brick and ``several`` of the others."""
    small, wide = whole.by_extent(voxels)
    return one(small) if wide is None else one(small).unionByName(several(wide))


def _adaptive_over_bricks(voxels: DataFrame, value: str, psi: float, stride: int) -> DataFrame:
    flat = stencil.gradient_magnitude(voxels, value, "__gradient")
    on = [F.col(a) % stride == 0 for a in stencil.AXES]
    coarse = staged(regions.spanning_forest(flat, "__gradient", F.when(on[0] & on[1] & on[2], F.col("lin") + 1)))
    refined = staged(refine_regions(coarse, "__gradient", heterogeneous_regions(coarse, value, psi), stride))
    finer = refined.where("mixed").select("case_id").distinct().withColumn("__finer", F.lit(True))
    pieces = split_by_intensity(refined.withColumnRenamed("label", "__coarse"), value, psi)
    out = pieces.join(finer, "case_id", "left")
    return out.select(*voxels.columns, F.when(F.col("__finer"), F.col("label")).otherwise(F.col("__coarse")).alias("label"))


def anchored_contract(voxels: DataFrame, value: str, psi: float, alpha: float, beta_max: int | None = None) -> DataFrame:
    """``voxels`` with ``label``: connected regions whose voxels all lie within max(psi, alpha) of their seed.

    Seeds are visited in a fixed order over the whole case; each takes what it reaches among the voxels that are
    left, breadth first, ``beta_max`` voxels at most; the rest stays for later seeds. ``label`` is the seed's
    ``lin`` + 1.
    """
    return _by_extent(voxels, lambda small: whole.contracted(small, value, "anchored", psi, alpha, beta_max, 0, 1), lambda wide: _anchored_over_bricks(wide, value, psi, alpha, beta_max))


def _anchored_over_bricks(voxels: DataFrame, value: str, psi: float, alpha: float, beta_max: int | None) -> DataFrame:
    found, _ = growth.grown(voxels, value, max(psi, alpha), beta_max)
    return found.withColumn("label", F.coalesce(F.col("seed") + 1, F.lit(0)).cast("bigint")).select(*[c for c in voxels.columns if c != "label"], "label")


def merge_similar_regions(labelled: DataFrame, value: str, alpha: float, beta_max: int, max_rounds: int = 101) -> DataFrame:
    """Merge adjacent regions while their means differ by at most alpha and they fit in beta_max together.

    In rounds over the tables of regions and of their adjacency; voxels are read once to make these and once to be
    renamed. The new mean is that of all voxels. Stops when no admissible pair is left or after ``max_rounds``. A
    merged region has the least of its labels.
    """
    sums = labelled.where("label > 0").groupBy("case_id", "label").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("total"))
    found = regions.merged(sums, E.shared_faces(labelled), alpha, beta_max, max_rounds).where("label <> merged")
    return labelled.join(found, ["case_id", "label"], "left").withColumn("label", F.coalesce("merged", "label")).select(*labelled.columns)


def merged_contract(voxels: DataFrame, value: str, psi: float, alpha: float, cap: int, most: int) -> DataFrame:
    """``anchored_contract`` with regions of at most ``cap`` voxels, then ``merge_similar_regions`` up to ``most``."""
    several = lambda wide: merge_similar_regions(staged(_anchored_over_bricks(wide, value, psi, alpha, cap)), value, alpha, most)
    return _by_extent(voxels, lambda small: whole.contracted(small, value, "anchored_capped", psi, alpha, cap, 0, 1, together=most), several)


def delete_nodes(labelled: DataFrame, value: str, beta_min: int = 10, beta_max: int = 500_000, m_min: float = -1e9, m_max: float = 1e9) -> DataFrame:
    """Regions outside the size and mean bounds get label 0; the others 1..K for each case, in order of their labels."""
    stats = labelled.where("label > 0").groupBy("case_id", "label").agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    kept = stats.where(F.col("n").between(beta_min, beta_max) & F.col("m").between(m_min, m_max))
    new = kept.select("case_id", "label", F.row_number().over(Window.partitionBy("case_id").orderBy("label")).cast("bigint").alias("__new"))
    return labelled.join(new, ["case_id", "label"], "left").withColumn("label", F.coalesce("__new", F.lit(0)).cast("bigint")).select(*labelled.columns)


def minor_stats(voxels: DataFrame, contracted: DataFrame, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Per case: voxels, labels after contraction, regions left, edges, and voxels per region."""
    n = voxels.groupBy("case_id").agg(F.count("*").alias("voxels"))
    c = contracted.groupBy("case_id").agg(F.countDistinct("label").alias("contracted"))
    k = labels.where("label > 0").groupBy("case_id").agg(F.countDistinct("label").alias("supernodes"))
    e = edges.groupBy("case_id").agg(F.count("*").alias("edges"))
    out = n.join(c, "case_id", "left").join(k, "case_id", "left").join(e, "case_id", "left").fillna(0, ["supernodes", "edges"])
    return out.withColumn("compression", F.col("voxels") / F.greatest("supernodes", F.lit(1)))


def contracted(voxels: DataFrame, value: str, method: str, psi: float, alpha: float, beta_max: int, bins: int = 8, stride: int = 20) -> DataFrame:
    """``voxels`` with ``label`` by one of the methods of ``build_minor``."""
    if method == "adaptive":
        return adaptive_contract(voxels, value, psi, stride)
    if method == "quantized":
        return quantized_components(voxels, value, bins)
    if method == "anchored":
        return anchored_contract(voxels, value, psi, alpha)
    if method == "anchored_capped":
        return merged_contract(voxels, value, psi, alpha, beta_max, beta_max)
    raise ValueError(f"unknown method: {method}")


def region_counts(voxels: DataFrame, value: str, method: str, psi: float, alpha: float, beta_max: int, bins: int = 8, stride: int = 20, extent: tuple[DataFrame, DataFrame | None] | None = None) -> DataFrame:
    """``features.region_counts`` of ``contracted``; cases in one brick send no voxels back from Python.

    extent: ``whole.by_extent`` of the voxels, if it is known.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    small, wide = extent or whole.by_extent(voxels)
    capped = method == "anchored_capped"
    one = whole.counted(small, value, method, psi, alpha, beta_max if capped else None, bins, stride, beta_max if capped else 0)
    return one if wide is None else one.unionByName(features.region_counts(staged(contracted(wide, value, method, psi, alpha, beta_max, bins, stride)), value))


def labelled(voxels: DataFrame, value: str, method: str = "adaptive", psi: float = 0.03, alpha: float = 0.2, beta_min: int = 10, beta_max: int = 500_000, m_min: float = -1e9, m_max: float = 1e9, bins: int = 8, stride: int = 20) -> tuple[DataFrame, DataFrame]:
    """(``voxels`` with their regions, the same after deletion), both written. Cases in one brick do both in one task."""

    def separate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = staged(contracted(df, value, method, psi, alpha, beta_max, bins, stride))
        return found, staged(delete_nodes(found, value, beta_min, beta_max, m_min, m_max))

    if method not in ("adaptive", "anchored", "quantized"):  # merging makes regions of all voxels first
        return separate(voxels)
    small, wide = whole.by_extent(voxels)
    both = staged(whole.contracted(small, value, method, psi, alpha, None, bins, stride, bounds=(beta_min, beta_max, m_min, m_max)))
    found, labels = both.drop("kept"), both.drop("label").withColumnRenamed("kept", "label")
    if wide is None:
        return found, labels
    more = separate(wide)
    return found.unionByName(more[0]), labels.unionByName(more[1])


def build_minor(voxels: DataFrame, value: str, method: str = "adaptive", psi: float = 0.03, alpha: float = 0.2, beta_min: int = 10, beta_max: int = 500_000, m_min: float = -1e9, m_max: float = 1e9, bins: int = 8, stride: int = 20) -> dict[str, DataFrame]:
    """Contract, delete nodes, derive edges: ``labels``, ``edges`` (mean difference at most alpha), ``all_edges``, ``stats``.

    Methods: ``adaptive``, ``anchored``, ``anchored_capped`` (with merging, as the native path does), ``quantized``.
    """
    found, labels = labelled(voxels, value, method, psi, alpha, beta_min, beta_max, m_min, m_max, bins, stride)
    every = staged(E.full_adjacency(labels, value))
    kept = every.where(F.col("mean_diff") <= alpha)
    return {"contracted": found, "labels": labels, "edges": kept, "all_edges": every, "stats": minor_stats(voxels, found, labels, kept)}
