"""Synthetic labelled volumes derived from the driver tables: one 16 x 16 x 16 volume for each supplier.

All arithmetic is over whole numbers, so every engine computes the same voxels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelgraph.session import table

SIDE = 16
#: Cases that a task makes the voxels of: about a million voxels.
CASES = 256

_BODY = """
WITH b AS (
  SELECT s_suppkey AS case_id, x, y, z,
    (x-8)*(x-8)+(y-8)*(y-8)+(z-8)*(z-8) AS d_org,
    (x-(5+s_suppkey%6))*(x-(5+s_suppkey%6))+(y-(5+s_nationkey%6))*(y-(5+s_nationkey%6))
      +(z-(5+(s_suppkey+s_nationkey)%6))*(z-(5+(s_suppkey+s_nationkey)%6)) AS d_t1,
    (x-3)*(x-3)+(y-12)*(y-12)+(z-12)*(z-12) AS d_t2
  FROM {grid}),
s AS (
  SELECT case_id, x, y, z,
    CASE WHEN case_id%7<>0 AND (d_t1<=1+case_id%5 OR (case_id%3=0 AND d_t2<=4)) THEN 2
         WHEN d_org<=36 THEN 1 ELSE 0 END AS seg
  FROM b)
SELECT CAST(case_id AS BIGINT) AS case_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z,
  CAST((x*16+y)*16+z AS BIGINT) AS lin,
  CAST((CASE seg WHEN 2 THEN 40 WHEN 1 THEN 100 ELSE -60+8*x END) + ((x*31+y*17+z*7+case_id*13)%11) - 5 AS DOUBLE) AS hu,
  CAST(seg AS INT) AS seg
FROM s"""

_CASES = """
SELECT CAST(s_suppkey AS BIGINT) AS case_id, CASE WHEN s_suppkey % 2 = 0 THEN 'LiTS' ELSE 'MSD_Task07_Pancreas' END AS dataset,
  16 AS nx, 16 AS ny, 16 AS nz, CAST(1.0 AS DOUBLE) AS sx, CAST(1.0 + (s_suppkey % 3) * 0.25 AS DOUBLE) AS sy, CAST(2.5 AS DOUBLE) AS sz
FROM {supplier}"""

#: Common table expressions of the same tables for DuckDB.
SQL = (
    "voxels AS (" + _BODY.format(grid="supplier CROSS JOIN (SELECT CAST(range AS INT) AS x FROM range(16)) rx CROSS JOIN (SELECT CAST(range AS INT) AS y FROM range(16)) ry CROSS JOIN (SELECT CAST(range AS INT) AS z FROM range(16)) rz") + "),\n"
    "cases AS (" + _CASES.format(supplier="supplier") + ")"
)


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, x, y, z, lin, hu, seg``; a generator makes the voxels where the case is, without a join.

    A supplier table is a few small files, so its rows are dealt by case before they become volumes: tasks grow
    with the cases, and what groups voxels by case and more finds them together without a shuffle of voxels.
    """
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-suppliers.count() // CASES))
    axis = "explode(sequence(0, 15))"
    grid = suppliers.repartition(tasks, "s_suppkey").selectExpr("*", f"{axis} AS x").selectExpr("*", f"{axis} AS y").selectExpr("*", f"{axis} AS z")
    return spark.sql(_BODY.format(grid="{grid}"), grid=grid)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, dataset, nx, ny, nz, sx, sy, sz``."""
    return spark.sql(_CASES.format(supplier="{supplier}"), supplier=table(spark, sf_dir, "supplier"))
