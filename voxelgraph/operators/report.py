"""Comparison reports between derived and reference measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgraph.functions import scalars


def _error(derived: str, truth: str) -> Column:
    return F.when(F.col(truth) > 0, F.abs(F.col(derived) - F.col(truth)) / F.col(truth))


def compare_case(gt: DataFrame, derived: DataFrame) -> DataFrame:
    """``(feature, mean_error, n)``: relative errors per case where the truth is above 0; the diameter follows the summed volume."""
    d = derived.groupBy("case_id").agg(F.sum("volume_cm3").alias("v"), F.sum("coverage_pct").alias("c"), F.min("distance_to_organ_mm").alias("m"))
    j = gt.join(d, "case_id").withColumn("di", scalars.sphere_diameter(F.col("v")))
    pairs = {"volume_cm3": ("v", "tumour_cm3"), "diameter_mm": ("di", "diameter_mm"), "coverage_pct": ("c", "coverage_pct"), "distance_to_organ_mm": ("m", "distance_to_organ_mm")}
    long = j.select(F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), _error(a, b).alias("e")) for k, (a, b) in pairs.items()))).alias("x")).select("x.*")
    return long.groupBy("feature").agg(F.avg("e").alias("mean_error"), F.count("e").alias("n"))


def compare_case_csv(reference: DataFrame, derived: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case: summed volume and coverage, largest diameter, least distance beside the reference row, with percent errors.

    ``reference`` has ``case_id, tumour_voxels, coverage_pct, distance_voxels``.
    """
    first = lambda c: F.min_by(c, "tumor_idx").alias(c)
    d = derived.groupBy("case_id").agg(
        F.sum("volume_cm3").alias("volume_cm3"), F.max("diameter_mm").alias("diameter_mm"), F.sum("coverage_pct").alias("coverage_pct"), F.min("distance_to_organ_mm").alias("distance_to_organ_mm"),
        F.avg("compactness").alias("compactness"), F.avg("elongation").alias("elongation"), first("morphology"), first("t_stage"), first("subregion"),
    )
    r = reference.join(cases.select("case_id", "sx", "sy", "sz"), "case_id")
    ref_cm3 = scalars.to_cm3(F.col("tumour_voxels"), F.col("sx"), F.col("sy"), F.col("sz"))
    r = r.select("case_id", ref_cm3.alias("ref_volume_cm3"), scalars.sphere_diameter(F.greatest(ref_cm3, F.lit(0.001))).alias("ref_diameter_mm"), F.col("coverage_pct").alias("ref_coverage_pct"), (F.col("distance_voxels") * F.col("sx")).alias("ref_distance_to_organ_mm"))
    j = r.join(d, "case_id", "left")
    numbers = ("volume_cm3", "diameter_mm", "coverage_pct", "distance_to_organ_mm", "compactness", "elongation")
    j = j.fillna(0.0, list(numbers)).fillna("N/A", ["morphology", "t_stage", "subregion"])
    return j.withColumns({f"{c}_error_pct": 100.0 * _error(c, f"ref_{c}") for c in numbers[:4]})


def compare_means(reference: DataFrame, derived: DataFrame) -> DataFrame:
    """One row: means of both sides and the ratio of their tumour counts."""
    r = reference.agg(F.count("*").alias("ref_tumours"), F.avg("tumour_voxels").alias("ref_voxels"), F.avg("coverage_pct").alias("ref_coverage_pct"), F.avg("distance_voxels").alias("ref_distance"))
    d = derived.agg(
        F.count("*").alias("tumours"), F.avg(F.col("volume_cm3") * 1000).alias("mean_mm3"), F.avg("coverage_pct").alias("mean_coverage_pct"), F.avg("distance_to_organ_mm").alias("mean_distance_mm"), F.avg("compactness").alias("mean_compactness"), F.avg("elongation").alias("mean_elongation")
    )
    return r.crossJoin(d).withColumn("tumour_ratio", F.col("tumours") / F.greatest("ref_tumours", F.lit(1)))  # one row each


def category_distribution(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``(category, value, n)`` for each of the columns, in one pass; empty and null values don't count."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    return long.where("value is not null and value <> ''").groupBy("category", "value").agg(F.count("*").alias("n"))


def derived_vs_csv_volumes(voxels: DataFrame, reference: DataFrame) -> DataFrame:
    """Tumour and organ voxels and coverage per case beside the reference row."""
    t, o = F.sum((F.col("seg") == 2).cast("bigint")), F.sum((F.col("seg") == 1).cast("bigint"))
    own = voxels.groupBy("case_id").agg(t.alias("tumour"), o.alias("organ")).withColumn("coverage", 100.0 * F.col("tumour") / F.greatest("organ", F.lit(1)))
    return own.join(reference, "case_id")
