"""The volumes of the fixture: tasks grow with the cases, cases stay together."""

from pyspark.sql import functions as F

from voxelgraph.operators import bricks, distance, search, stencil
from voxelgraph.plans import fixture
from voxelgraph.session import staged
from voxelgraph.sources import volumes


def suppliers(spark, path, n):
    rows = spark.range(1, n + 1).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey"))
    rows.coalesce(1).write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_one_small_file_becomes_many_tasks_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixture, "CASES", 2)
    v = fixture.voxels(spark, suppliers(spark, tmp_path, 120))
    of = v.withColumn("p", F.spark_partition_id())
    held = of.groupBy("case_id").agg(F.count("*").alias("n"), F.countDistinct("lin").alias("places"), F.countDistinct("p").alias("parts"), F.min("p").alias("part")).collect()
    assert len(held) == 120 and {(r.n, r.places, r.parts) for r in held} == {(4096, 4096, 1)}
    assert len({r.part for r in held}) > 30  # of 60 tasks; a task's share is a hash of the case
    files = staged(v).select(F.input_file_name().alias("f")).distinct().count()
    assert files > 30


def test_no_voxel_is_shuffled_to_its_brick(spark, tmp_path):
    v = fixture.voxels(spark, suppliers(spark, tmp_path, 20))
    plan = stencil.with_surface(v, F.col("seg") >= 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "s_suppkey" in plan.split("Exchange hashpartitioning")[1].split("\n")[0]


def test_voxels_on_borders_go_to_each_brick_that_they_touch(spark):
    side = 3
    rows = [(0, x, y, z) for x in range(5) for y in range(4) for z in range(7)]
    df = spark.createDataFrame(rows, "case_id bigint, x int, y int, z int")
    got = {(r.x, r.y, r.z, r.b, r.own) for r in bricks._dealt(df, side, True).select("x", "y", "z", F.col("__brick").alias("b"), F.col("__own").alias("own")).collect()}
    want = set()
    for _, *at in rows:
        near = [[0] + ([-1] if p > 0 and p % side == 0 else []) + ([1] if p % side == side - 1 else []) for p in at]
        for d in [(i, j, k) for i in near[0] for j in near[1] for k in near[2]]:
            place = [p // side + s for p, s in zip(at, d, strict=True)]
            want.add((*at, (place[0] << 40) + (place[1] << 20) + place[2], d == (0, 0, 0)))
    assert got == want


def test_distances_of_asked_voxels_take_no_others_through_the_groups(spark, monkeypatch):
    rows = [(0, x, y, z, (x * 5 + y) * 5 + z, 2 if x == 0 else 1 if (x, y, z) == (4, 1, 3) else 0) for x in range(5) for y in range(5) for z in range(5)]
    df = spark.createDataFrame(rows, "case_id bigint, x int, y int, z int, lin bigint, seg int")
    cases = spark.createDataFrame([(0, 5, 5, 5, 1.0, 2.0, 3.0)], "case_id bigint, nx int, ny int, nz int, sx double, sy double, sz double")
    dealt, real = [], distance._pass
    monkeypatch.setattr(distance, "_pass", lambda rows, *more: dealt.append(rows.count()) or real(rows, *more))
    got = {(r.y, r.z): r.distance for r in distance.with_distance(df, F.col("seg") == 2, F.col("seg") == 1, cases, asked=True).collect()}
    assert dealt == [26]
    assert got == {(y, z): (16 + 4 * (y - 1) ** 2 + 9 * (z - 3) ** 2) ** 0.5 for y in range(5) for z in range(5)}


def test_each_psi_of_a_grid_scores_as_its_own_contraction(spark, monkeypatch):
    rows = [(c, x, y, z, (x * 4 + y) * 4 + z, ((x * 7 + y * 3 + z * 5 + c) % 10) / 10, int(x > 1) + int(x > 2)) for c in range(2) for x in range(4) for y in range(4) for z in range(4)]
    df = spark.createDataFrame(rows, "case_id bigint, x int, y int, z int, lin bigint, v double, seg int")
    configs = [(k, psi, 0.1, 1, 99, 0.0, 1.0) for k, psi in enumerate((0.3, 0.26, 0.45, 0.2))]  # 4, 4, 3 and 5 bins
    made, real = [], search.variants
    monkeypatch.setattr(search, "variants", lambda voxels, options: made.append(options.count()) or real(voxels, options))
    score = lambda some: {(r.config_id, r.case_id): (r.dice, r.supernodes) for r in search.grid_search(df, "v", spark.createDataFrame(some, search.CONFIG), measure="volume").collect()}
    together = score(configs)
    assert made == [3] and together == {k: v for c in configs for k, v in score([c]).items()}


def test_results_by_case_are_few_files_with_whole_cases(spark, tmp_path):
    rows = [(c, label, c * label) for c in range(60) for label in range(3)]
    volumes.write_results_json(spark.createDataFrame(rows, "case_id bigint, label bigint, n bigint").repartition(5), str(tmp_path / "j"), by_case=True)
    back = spark.read.schema("case_id bigint, label bigint, n bigint").json(str(tmp_path / "j")).withColumn("f", F.input_file_name())
    assert sorted(map(tuple, back.drop("f").collect())) == rows
    assert back.groupBy("case_id").agg(F.countDistinct("f").alias("k")).where("k > 1").isEmpty()
    assert len(list((tmp_path / "j").rglob("*.json"))) <= 8


def test_a_window_sweep_makes_no_copies_of_the_voxels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "variants", None)
    found = search.window_sweep(fixture.voxels(spark, suppliers(spark, tmp_path, 6)), {"a": (0.0, 200.0), "b": (-50.0, 250.0)})
    assert {(r.window, r.cases) for r in found.collect()} == {("a", 6), ("b", 6)}
