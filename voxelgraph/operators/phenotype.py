"""Distances, tumour phenotypes, grouped tumours and knowledge-graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelgraph.functions import scalars
from voxelgraph.operators import contract, distance, evaluate, features, stencil
from voxelgraph.session import staged

KG_NODE = "id string, type string, name string, modality string, value double, term string, dataset string, case_id bigint, supernode_id bigint, props map<string,double>"


def distance_to_mask(voxels: DataFrame, query: Column, mask: Column, cases: DataFrame) -> DataFrame:
    """``(case_id, lin, distance)``: exact Euclidean distance in mm from each query voxel to the nearest mask voxel.

    No row for a case without a mask.
    """
    held = voxels.select("case_id", *stencil.AXES, "lin", query.alias("__q"), mask.alias("__m"))
    return distance.with_distance(held, F.col("__q"), F.col("__m"), cases, asked=True).where("distance is not null").select("case_id", "lin", "distance")


def min_distance_per_label(labelled: DataFrame, cases: DataFrame, labels: DataFrame | None = None, organ: Column | None = None) -> DataFrame:
    """``(case_id, label, distance, mean_distance)`` over the voxels of each label (only of ``labels``, if given).

    The organ is class 1 unless said otherwise; without an organ voxel in a case the distance is 0.
    """
    held = labelled.withColumn("__o", F.col("seg") == 1 if organ is None else organ)
    held = held.withColumn("__q", F.col("label") > 0) if labels is None else held.join(labels.select("case_id", "label", F.lit(True).alias("__q")), ["case_id", "label"], "left").withColumn("__q", F.coalesce("__q", F.lit(False)))
    asked = distance.with_distance(held.select("case_id", *stencil.AXES, "label", "__q", "__o"), F.col("__q"), F.col("__o"), cases, asked=True)
    return asked.groupBy("case_id", "label").agg(F.coalesce(F.min("distance"), F.lit(0.0)).alias("distance"), F.coalesce(F.avg("distance"), F.lit(0.0)).alias("mean_distance"))


def select_tumour_nodes(counts: DataFrame, threshold: float = 0.1, given: DataFrame | None = None) -> DataFrame:
    """``(case_id, label)``: the given ids that exist, else regions with a tumour share over the threshold."""
    regions = counts.where("label > 0")
    if given is not None:
        return regions.join(given, ["case_id", "label"], "left_semi").select("case_id", "label")
    return regions.where(evaluate.share(threshold)).select("case_id", "label")


def coverage(mode: str, tumour: Column, others: Column | None = None, organ: Column | None = None) -> Column:
    """Percent of tumour: ``minor``: of the tumour and all other regions; ``organ``: of the organ; ``both``: of organ and tumour."""
    base = {"minor": lambda: others + tumour, "organ": lambda: organ, "both": lambda: organ + tumour}[mode]()
    return 100.0 * tumour / F.greatest(base, F.lit(1))


def phenotypes(nodes: DataFrame, chosen: DataFrame, distances: DataFrame, cases: DataFrame) -> DataFrame:
    """One row for each chosen region with features; ``tumor_idx`` counts the chosen ids, so gaps are possible."""
    numbered = chosen.withColumn("tumor_idx", F.row_number().over(Window.partitionBy("case_id").orderBy("label")) - 1)
    marked = nodes.join(numbered.withColumn("__t", F.lit(True)), ["case_id", "label"], "left")
    rest = marked.groupBy("case_id").agg(F.sum(F.when(F.col("__t").isNull(), F.col("volume")).otherwise(0)).alias("others"))
    d = distances.select("case_id", "label", "distance")
    j = marked.where("__t").join(rest, "case_id").join(d, ["case_id", "label"], "left").join(cases.select("case_id", "dataset", "nz", "sx", "sy", "sz"), "case_id")
    cm3 = scalars.to_cm3(F.col("volume"), F.col("sx"), F.col("sy"), F.col("sz"))
    out = j.withColumn("volume_cm3", cm3).withColumn("diameter_mm", scalars.sphere_diameter(F.col("volume_cm3")))
    return out.select(
        "case_id",
        "dataset",
        "tumor_idx",
        F.col("label").alias("supernode_id"),
        "volume_cm3",
        "diameter_mm",
        coverage("minor", F.col("volume"), others=F.col("others")).alias("coverage_pct"),
        "compactness",
        "elongation",
        scalars.dataset_subregion(F.col("dataset"), F.col("centroid")[2], F.col("nz")).alias("subregion"),
        scalars.morphology(F.col("compactness"), F.col("elongation")).alias("morphology"),
        scalars.t_stage(F.col("diameter_mm"), F.col("volume_cm3")).alias("t_stage"),
        F.coalesce("distance", F.lit(0.0)).alias("distance_to_organ_mm"),
        "mean_intensity",
        "intensity_std",
    )


KG_FEATURES = ("volume_cm3", "diameter_mm", "coverage_pct", "compactness", "elongation", "mean_intensity", "intensity_std", "distance_to_organ_mm")


def _tumour_id() -> Column:
    return F.concat(F.lit("case_"), F.col("case_id").cast("string"), F.lit("_tumor_"), F.col("tumor_idx").cast("string"))


def kg_nodes(found: DataFrame, cases: DataFrame) -> DataFrame:
    """Organ, Disease, Tumor, Anatomy, Stage, Feature and Observation nodes of each case, not yet deduplicated."""
    organ, disease = scalars.dataset_organ(F.col("dataset")), scalars.dataset_disease(F.col("dataset"))

    def shared(rows: DataFrame, prefix: str, kind: str, name: Column, seq: Column, term: Column | None = None) -> DataFrame:
        return rows.select(scalars.slug_id(prefix, name).alias("id"), F.lit(kind).alias("type"), name.alias("name"), (F.lit(None) if term is None else term).cast("string").alias("term"), F.col("case_id").alias("of_case"), seq.alias("seq"))

    at = F.col("tumor_idx") * 20
    tumours = found.select(
        _tumour_id().alias("id"), F.lit("Tumor").alias("type"), F.concat(F.lit("tumor_"), F.col("tumor_idx").cast("string")).alias("name"), "dataset", "case_id", "supernode_id",
        F.create_map(*(x for c in ("compactness", "elongation", "mean_intensity", "intensity_std") for x in (F.lit(c), F.col(c)))).alias("props"), F.col("case_id").alias("of_case"), (at + 2).alias("seq"),
    )
    values = F.posexplode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in KG_FEATURES))).alias("k", "f")
    feats = found.select("case_id", "tumor_idx", values).select(F.concat(_tumour_id(), F.lit("_feat_"), F.col("f.name")).alias("id"), F.lit("Feature").alias("type"), "f.name", "f.value", F.col("case_id").alias("of_case"), (at + 5 + F.col("k")).alias("seq"))
    parts = [
        shared(cases, "organ", "Organ", organ, F.lit(0)),
        shared(cases, "disease", "Disease", disease, F.lit(1)),
        tumours,
        shared(found, "anatomy", "Anatomy", F.col("subregion"), at + 3),
        shared(found, "stage", "Stage", F.col("t_stage"), at + 4),
        feats,
        shared(found, "obs", "Observation", F.col("morphology"), at + 13, F.col("morphology")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("modality", F.lit("CT"))


def kg_edges(found: DataFrame) -> DataFrame:
    """``(case_id, source, target, relation)``; edges are not deduplicated."""
    t = _tumour_id()
    to = [
        ("part_of", scalars.slug_id("organ", scalars.dataset_organ(F.col("dataset")))),
        ("suggestive_of", scalars.slug_id("disease", scalars.dataset_disease(F.col("dataset")))),
        ("located_in", scalars.slug_id("anatomy", F.col("subregion"))),
        ("has_stage", scalars.slug_id("stage", F.col("t_stage"))),
        *(("has_feature", F.concat(t, F.lit(f"_feat_{c}"))) for c in KG_FEATURES),
        ("has_morphology", scalars.slug_id("obs", F.col("morphology"))),
    ]
    return found.select("case_id", t.alias("source"), F.explode(F.array(*(F.struct(target.alias("target"), F.lit(r).alias("relation")) for r, target in to))).alias("e")).select("case_id", "source", "e.target", "e.relation")


def dedupe_nodes(nodes: DataFrame, per_case: bool = False) -> DataFrame:
    """The first node of each id, in order of case and position: within each case, or over all.

    Kept by an aggregate, so an id that every case shares is combined before it is shuffled.
    """
    keys = ["of_case", "id"] if per_case else ["id"]
    rest = [c for c in nodes.columns if c not in (*keys, "of_case", "seq", "props")]
    props = F.map_entries("props").alias("props") if "props" in nodes.columns else F.lit(None).alias("props")
    held = nodes.select(*keys, F.struct(F.col("of_case").alias("c"), F.col("seq").alias("s"), *rest, props).alias("row"))
    first = held.groupBy(*keys).agg(F.min_by("row", F.struct("row.c", "row.s")).alias("row"))
    return first.select("id", F.col("row.c").alias("of_case"), *(F.col(f"row.{c}").alias(c) for c in rest), F.map_from_entries("row.props").alias("props"))


def kg_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(what, name, n)``: nodes by type and edges by relation."""
    return nodes.groupBy(F.col("type").alias("name")).count().select(F.lit("node").alias("what"), "name", F.col("count").alias("n")).unionByName(
        edges.groupBy(F.col("relation").alias("name")).count().select(F.lit("edge").alias("what"), "name", F.col("count").alias("n"))
    )


def patient_graph(counts: DataFrame, nodes: DataFrame, cases: DataFrame, organ_share: float = 0.3, tumour_share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """One organ and one tumour node for each case with size-weighted centroids in mm, and the edges between them."""
    organ = (F.col("n_organ") - F.col("n_tumour")) / F.col("n") > organ_share
    kind = F.when(evaluate.share(tumour_share), "tumour").when(organ, "organ")
    marked = counts.where("label > 0").withColumn("kind", kind).where("kind is not null").join(nodes.select("case_id", "label", "volume", "centroid"), ["case_id", "label"])
    spaced = marked.join(cases.select("case_id", "sx", "sy", "sz"), "case_id")
    mid = lambda k, s: (F.sum(F.col("centroid")[k] * F.col(s) * F.col("volume")) / F.sum("volume")).alias(f"c{'xyz'[k]}")
    points = spaced.groupBy("case_id", "kind").agg(F.sum("volume").alias("volume"), F.count("*").alias("regions"), mid(0, "sx"), mid(1, "sy"), mid(2, "sz"))
    points = staged(points)
    a, b = points.alias("a"), points.alias("b")
    gap = [F.col(f"a.c{k}") - F.col(f"b.c{k}") for k in "xyz"]
    pairs = a.join(b, (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.kind") < F.col("b.kind")))
    edges = pairs.select("a.case_id", F.col("a.kind").alias("source"), F.col("b.kind").alias("target"), F.sqrt(sum(g * g for g in gap)).alias("distance_mm"), coverage("both", F.col("b.volume"), organ=F.col("a.volume")).alias("coverage_pct"))
    return points, edges


def pooled_std(deviation: str, mean: str, weight: str, whole_mean: Column) -> Column:
    """sqrt of the weighted variance within and between parts."""
    between = F.col(mean) - whole_mean
    return F.sqrt(F.greatest(F.sum((F.col(deviation) * F.col(deviation) + between * between) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1)), F.lit(0.0)))


def group_tumours(labelled: DataFrame, nodes: DataFrame, counts: DataFrame, cases: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Physical tumours: components of the tumour regions' mask, measured from their regions and their own shape."""
    chosen = select_tumour_nodes(counts, threshold)
    masked = evaluate.lift(labelled, chosen.withColumn("pred", F.lit(1)))
    cc = staged(contract.connected(masked, F.when(F.col("pred") == 1, F.lit(1)), "tumour"))
    own = features.region_sums(cc.drop("label").withColumnRenamed("tumour", "label").where("label > 0"), F.lit(0.0))
    own = own.select("case_id", F.col("label").alias("tumour"), F.col("volume").alias("voxels"), F.col("boundary_length").alias("boundary"), *(c for c in own.columns if c[0] in "vc" and len(c) < 4))
    shaped = features.shape(own, "voxels", 3).withColumn("compactness", F.least(scalars.compactness(F.col("voxels"), F.col("boundary")), F.lit(1.0)))
    members = cc.where("tumour > 0").select("case_id", "tumour", "label").distinct().join(nodes.select("case_id", "label", "volume", "centroid", "mean_intensity", "intensity_std"), ["case_id", "label"])
    mean = members.groupBy("case_id", "tumour").agg((F.sum(F.col("mean_intensity") * F.col("volume")) / F.greatest(F.sum("volume"), F.lit(1))).alias("whole_mean"))
    parts = members.join(mean, ["case_id", "tumour"]).groupBy("case_id", "tumour").agg(
        F.sort_array(F.collect_set("label")).alias("supernode_ids"),
        F.sum("volume").alias("volume"),
        F.array(*(F.avg(F.col("centroid")[k]) for k in range(3))).alias("centroid"),
        F.first("whole_mean").alias("mean_intensity"),
        pooled_std("intensity_std", "mean_intensity", "volume", F.col("whole_mean")).alias("intensity_std"),
    )
    away = min_distance_per_label(cc.drop("label").withColumnRenamed("tumour", "label"), cases).toDF("case_id", "tumour", "distance_to_organ_mm", "mean_distance_mm")
    j = parts.join(shaped.drop("dominant_axis", "dominant_axis_vec"), ["case_id", "tumour"]).join(away, ["case_id", "tumour"]).join(cases.select("case_id", "nz", "sx", "sy", "sz"), "case_id")
    out = j.withColumn("volume_cm3", scalars.to_cm3(F.col("volume"), F.col("sx"), F.col("sy"), F.col("sz"))).withColumn("diameter_mm", scalars.sphere_diameter(F.col("volume_cm3")))
    return out.withColumns(
        {
            "morphology": scalars.morphology(F.col("compactness"), F.col("elongation")),
            "t_stage": scalars.t_stage(F.col("diameter_mm"), F.col("volume_cm3")),
            "subregion": scalars.subregion("half_x", F.col("centroid")[2], F.col("nz")),
            "n_supernodes": F.size("supernode_ids"),
        }
    ).drop("nz", "sx", "sy", "sz")


def _case_sums(voxels: DataFrame) -> DataFrame:
    t, o = F.col("seg") == 2, F.col("seg") == 1
    mid = [F.avg(F.when(m, F.col(a))).alias(f"{n}_{a}") for n, m in (("t", t), ("o", o)) for a in stencil.AXES]
    return voxels.groupBy("case_id").agg(F.sum(t.cast("bigint")).alias("tumour_voxels"), F.sum(o.cast("bigint")).alias("organ_voxels"), *mid)


def gt_phenotypes(voxels: DataFrame, cases: DataFrame) -> DataFrame:
    """Measures of the true tumour of each case that has one."""
    far = min_distance_per_label(voxels.withColumn("label", (F.col("seg") == 2).cast("bigint")), cases)
    j = _case_sums(voxels).where("tumour_voxels > 0").join(cases.select("case_id", "sx", "sy", "sz"), "case_id").join(far, "case_id")
    space = (F.col("sx"), F.col("sy"), F.col("sz"))
    out = j.withColumn("tumour_cm3", scalars.to_cm3(F.col("tumour_voxels"), *space)).withColumn("organ_cm3", scalars.to_cm3(F.col("organ_voxels"), *space))
    at = lambda n: F.array(*(F.coalesce(F.col(f"{n}_{a}"), F.lit(0.0)) * F.col(f"s{a}") for a in stencil.AXES))
    return out.select(
        "case_id", "tumour_voxels", "organ_voxels", "tumour_cm3", "organ_cm3", coverage("organ", F.col("tumour_voxels"), organ=F.col("organ_voxels")).alias("coverage_pct"),
        scalars.sphere_diameter(F.col("tumour_cm3")).alias("diameter_mm"), F.col("distance").alias("distance_to_organ_mm"), at("t").alias("tumour_centroid_mm"), at("o").alias("organ_centroid_mm"),
    )


def _box_and_hu(rows: DataFrame, keys: list[str]) -> DataFrame:
    size = [((F.max(a) - F.min(a) + 1)).alias(f"box_{a}") for a in stencil.AXES]
    return rows.groupBy(*keys).agg(*size, F.avg("hu").alias("hu_mean"), F.stddev_pop("hu").alias("hu_std"), F.min("hu").alias("hu_min"), F.max("hu").alias("hu_max"))


def case_metadata(voxels: DataFrame, cases: DataFrame) -> DataFrame:
    """``gt_phenotypes`` with the box in mm, subregion against the organ, raw intensities, stage and spacing."""
    base = gt_phenotypes(voxels, cases)
    more = _box_and_hu(voxels.where("seg = 2"), ["case_id"])
    mids = _case_sums(voxels).select("case_id", "t_z", "o_z")
    j = base.join(more, "case_id").join(mids, "case_id").join(cases, "case_id")
    boxes = {f"box_{a}": F.col(f"box_{a}") * F.col(f"s{a}") for a in stencil.AXES}
    return j.withColumns(boxes).withColumn("subregion", scalars.subregion("relative_z", F.col("t_z"), organ=F.col("o_z"))).withColumn("t_stage", scalars.t_stage(F.col("diameter_mm"), F.col("tumour_cm3"))).drop("t_z", "o_z", "nx", "ny", "nz")


def tumour_metadata(voxels: DataFrame, cases: DataFrame) -> DataFrame:
    """One row for each component of the true tumour."""
    own = staged(contract.connected(voxels.where("seg = 2"), F.lit(2)))
    cc = own.unionByName(voxels.where("seg = 1").withColumn("label", F.lit(0).cast("bigint")))
    sizes = own.groupBy("case_id", "label").agg(F.count("*").alias("voxels"), *(F.avg(a).alias(f"c{a}") for a in stencil.AXES))
    sums = _case_sums(voxels).select("case_id", "organ_voxels", "o_z")
    count = own.groupBy("case_id").agg(F.countDistinct("label").alias("n_tumours"))
    j = sizes.join(_box_and_hu(own, ["case_id", "label"]), ["case_id", "label"]).join(min_distance_per_label(cc, cases), ["case_id", "label"]).join(sums, "case_id").join(count, "case_id").join(cases.drop("nx", "ny", "nz"), "case_id")
    out = j.withColumn("volume_cm3", scalars.to_cm3(F.col("voxels"), F.col("sx"), F.col("sy"), F.col("sz"))).withColumn("diameter_mm", scalars.sphere_diameter(F.col("volume_cm3")))
    return out.withColumns(
        {
            "coverage_pct": coverage("organ", F.col("voxels"), organ=F.col("organ_voxels")),
            "subregion": scalars.subregion("organ_centroid", F.col("cz"), organ=F.col("o_z")),
            "t_stage": scalars.t_stage(F.col("diameter_mm"), F.col("volume_cm3")),
            **{f"box_{a}": F.col(f"box_{a}") * F.col(f"s{a}") for a in stencil.AXES},
        }
    ).drop("o_z")
