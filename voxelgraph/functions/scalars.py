"""Column expressions: windows, bins, measures, categories and the 3 x 3 eigenproblem."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Intensity windows by use.
WINDOWS = {"pancreas": (20.0, 180.0), "liver": (0.0, 200.0), "resumable": (-50.0, 250.0), "grouping": (-150.0, 250.0), "wide": (-100.0, 200.0)}
#: What each dataset images, with the default for any other.
ORGANS = {"LiTS": "liver", "MSD_Task07_Pancreas": "pancreas", "FLARE2023": "multi_organ"}
DISEASES = {"LiTS": "hepatocellular_carcinoma", "MSD_Task07_Pancreas": "pancreatic_adenocarcinoma", "FLARE2023": "abdominal_malignancy"}
DEFAULT_ORGAN, DEFAULT_DISEASE = "organ", "malignancy"


def hu_window(hu: Column, low: float, high: float) -> Column:
    """Intensity clipped to [low, high] and scaled to [0, 1]; null stays null."""
    return (F.greatest(F.least(hu, F.lit(float(high))), F.lit(float(low))) - low) / (high - low)


def quantize(value: Column, bins: int | Column) -> Column:
    """Bin 0 to ``bins`` - 1 (one number, or one for each row) of a value in [0, 1]."""
    return F.least(F.greatest(F.floor(value * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def psi_bins(psi: float) -> int:
    """How many bins a merge tolerance asks for."""
    return max(2, math.ceil(1.0 / max(psi, 1e-6)))


def class_mask(seg: Column, what: str) -> Column:
    """``organ`` (class 1), ``tumour`` (class 2) or ``any`` (both)."""
    return {"organ": seg == 1, "tumour": seg == 2, "any": seg >= 1}[what]


def voxel_volume(sx: Column, sy: Column, sz: Column) -> Column:
    return sx * sy * sz


def to_cm3(voxels: Column, sx: Column, sy: Column, sz: Column) -> Column:
    return voxels * sx * sy * sz / 1000.0


def sphere_diameter(cm3: Column) -> Column:
    """Diameter in mm of the sphere of a volume in cm3."""
    return 2.0 * F.pow(3.0 * cm3 * 1000.0 / (4.0 * math.pi), F.lit(1.0 / 3.0))


def t_stage(diameter: Column, cm3: Column) -> Column:
    return F.when(diameter <= 20, "T1").when(diameter <= 40, "T2").when(cm3 <= 50, "T3").otherwise("T4")


def morphology(compactness: Column, elongation: Column) -> Column:
    return F.when(compactness > 0.6, "spherical").when(elongation > 5, "irregular").otherwise("ovoid")


def slug_id(prefix: str, name: Column) -> Column:
    """``prefix_name`` in lower case, blanks as underscores, without commas and stops."""
    return F.concat(F.lit(prefix + "_"), F.translate(F.replace(F.lower(name), F.lit(" "), F.lit("_")), ",.", ""))


def lookup(key: Column, values: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def dataset_organ(dataset: Column) -> Column:
    return lookup(dataset, ORGANS, DEFAULT_ORGAN)


def dataset_disease(dataset: Column) -> Column:
    return lookup(dataset, DISEASES, DEFAULT_DISEASE)


def compactness(volume: Column, boundary: Column) -> Column:
    """36 pi V^2 / b^3; huge for b = 0, as it stands."""
    return 36.0 * math.pi * volume * volume / (F.pow(boundary.cast("double"), F.lit(3.0)) + 1e-8)


def with_eigen3(df: DataFrame, columns: tuple[str, str, str, str, str, str]) -> DataFrame:
    """Add ``l1, l2, l3`` (eigenvalues of a symmetric matrix, descending) and ``axis``, the first one's unit vector.

    ``columns``: xx, yy, zz, xy, xz, yz. Closed form (the trigonometric solution of the characteristic
    polynomial), in steps, so that no expression is written out twice. The vector is the largest cross
    product of two rows of A - l1 I; where all vanish (a double first value) it falls back to the unit vector
    of the largest diagonal entry. A null entry gives nulls.
    """
    xx, yy, zz, xy, xz, yz = (F.col(c).cast("double") for c in columns)
    names = df.columns
    m, p2, p, phi = (F.col(f"__{n}") for n in ("m", "p2", "p", "phi"))
    out = df.withColumn("__m", (xx + yy + zz) / 3.0)
    out = out.withColumn("__p2", (xx - m) * (xx - m) + (yy - m) * (yy - m) + (zz - m) * (zz - m) + 2.0 * (xy * xy + xz * xz + yz * yz))
    out = out.withColumn("__p", F.when(p2 > 1e-24, F.sqrt(p2 / 6.0)))
    out = out.withColumns({f"__{n}": v / p for n, v in (("a", xx - m), ("b", yy - m), ("c", zz - m), ("d", xy), ("e", xz), ("f", yz))})
    a, b, c, d, e, f = (F.col(f"__{n}") for n in "abcdef")
    out = out.withColumn("__phi", F.acos(F.greatest(F.least((a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2.0, F.lit(1.0)), F.lit(-1.0))) / 3.0)
    out = out.withColumns({"l1": F.coalesce(m + 2.0 * p * F.cos(phi), m), "l3": F.coalesce(m + 2.0 * p * F.cos(phi + 2.0 * math.pi / 3.0), m)})
    l1 = F.col("l1")
    rows = ((xx - l1, xy, xz), (xy, yy - l1, yz), (xz, yz, zz - l1))

    def cross(u, v):
        return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])

    out = out.withColumns({f"__v{k}": F.array(*cross(rows[i], rows[j])) for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)))})
    norm = lambda v: v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    out = out.withColumns({f"__n{k}": norm(F.col(f"__v{k}")) for k in range(3)})
    out = out.withColumn("__best", F.greatest(*(F.struct(F.col(f"__n{k}").alias("n"), F.col(f"__v{k}").alias("v")) for k in range(3))))
    out = out.withColumn("__len", F.sqrt("__best.n"))
    unit = [F.array(*(F.lit(float(i == k)) for i in range(3))) for k in range(3)]
    top = F.greatest(xx, yy, zz)
    fallback = F.when(xx == top, unit[0]).when(yy == top, unit[1]).otherwise(unit[2])
    axis = F.when(F.col("__len") > 1e-9, F.transform("__best.v", lambda x: x / F.col("__len"))).when(m.isNotNull(), fallback)
    return out.withColumns({"l2": 3.0 * m - l1 - F.col("l3"), "axis": axis}).select(*names, "l1", "l2", "l3", "axis")


def subregion(rule: str, centre: Column, size: Column | None = None, organ: Column | None = None) -> Column:
    """Where a centroid lies on the third array axis, by one of four rules.

    ``half_x``: against half the extent ``size``; ``thirds_x``: share of the extent below 0.33, below 0.66 or
    above; ``relative_z``: distance from the organ's centroid relative to it, beyond 0.3; ``organ_centroid``:
    below or above the organ's centroid. Without an organ the last two are ``unknown``.
    """
    if rule == "half_x":
        return F.when(centre < size / 2.0, "right_lobe").otherwise("left_lobe")
    if rule == "thirds_x":
        share = centre / size
        return F.when(share < 0.33, "pancreatic_tail").when(share < 0.66, "pancreatic_body").otherwise("pancreatic_head")
    if rule == "relative_z":
        at = (centre - organ) / F.greatest(F.lit(1.0), F.abs(organ))
        return F.when(organ.isNull(), "unknown").when(at < -0.3, "tail").when(at > 0.3, "head").otherwise("body")
    if rule == "organ_centroid":
        return F.when(organ.isNull(), "unknown").when(centre < organ, "right_lobe").otherwise("left_lobe")
    raise ValueError(f"unknown rule: {rule}")


def dataset_subregion(dataset: Column, centre: Column, size: Column) -> Column:
    """The rule that each dataset takes."""
    return (
        F.when(dataset == "LiTS", subregion("half_x", centre, size))
        .when(dataset.isin("MSD_Task07_Pancreas", "pancreas"), subregion("thirds_x", centre, size))
        .otherwise("abdominal_organ")
    )
