"""Searches, grouped tumours and restarts against independent versions."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_contract import flood, table

from voxelgraph.functions import scalars
from voxelgraph.operators import evaluate, features, learn, phenotype, search
from voxelgraph.plans import fixture, pipelines
from voxelgraph.sources import volumes


def edge(m):
    wide, inner = np.pad(m, 1), m.copy()
    for k in range(3):
        for d in (-1, 1):
            inner &= np.roll(wide, d, k)[1:-1, 1:-1, 1:-1]
    return m & ~inner


def volumes_of(spark, arrays, segs):
    df, cases = table(spark, *arrays)
    truth = [(c, i, int(s)) for c, seg in enumerate(segs) for i, s in enumerate(seg.ravel())]
    return df.drop("seg").join(spark.createDataFrame(truth, "case_id long, lin long, seg int"), ["case_id", "lin"]), cases


def dice(p, t, empty_agrees=False):
    if not t.any():
        return 1.0 if not empty_agrees or not p.any() else 0.0
    return 2 * (p & t).sum() / (p.sum() + t.sum() + 1e-8)


@pytest.mark.parametrize("measure", ["boundary", "volume"])
def test_grid_search_by_hand(spark, measure):
    rng = np.random.default_rng(1)
    a = [np.round(rng.random((5, 5, 4)) / 2 + (np.indices((5, 5, 4))[0] > 2) * 0.5, 2), np.round(rng.random((4, 4, 4)), 2)]
    segs = [np.where((x > 0.5) & (rng.random(x.shape) < 0.8), 2, 0) for x in a]
    df, _ = volumes_of(spark, a, segs)
    rows = [(k, psi, psi, lo, 500, m0, m1) for k, (psi, lo, m0, m1) in enumerate((p, *q) for p in (0.5, 0.3, 0.21) for q in ((1, 0.0, 1.0), (4, 0.0, 1.0), (1, 0.6, 0.9), (90, 0.0, 1.0)))]
    got = {(r.config_id, r.case_id): r for r in search.grid_search(df, "v", spark.createDataFrame(rows, search.CONFIG), measure=measure).collect()}
    assert len(got) == len(rows) * len(a)
    for k, psi, _, lo, hi, m0, m1 in rows:
        n = scalars.psi_bins(psi)
        for case, (x, seg) in enumerate(zip(a, segs)):
            label = flood(np.clip(np.floor(x * n), 0, n - 1))
            kept = [i for i in np.unique(label) if lo <= (label == i).sum() <= hi and m0 <= x[label == i].mean() <= m1]
            mask = np.isin(label, [i for i in kept if (seg[label == i] == 2).mean() > 0.1])
            want = dice(edge(mask), edge(seg == 2)) if measure == "boundary" else dice(mask, seg == 2)
            assert np.isclose(got[k, case].dice, want) and got[k, case].supernodes == len(kept)
            assert np.isclose(got[k, case].compression, x.size / max(1, len(kept)))


def test_windows_in_one_job_by_hand(spark):
    rng = np.random.default_rng(2)
    a = [rng.integers(-100, 260, (4, 5, 4)).astype(float), rng.integers(0, 200, (3, 3, 3)).astype(float)]
    segs = [np.where((x > 60) & (x < 120), 2, 0) for x in a]
    df, _ = volumes_of(spark, a, segs)
    windows = {"narrow": (20.0, 180.0), "wide": (-150.0, 250.0)}
    got = {r.window: (r.mean_dice, r.cases) for r in search.window_sweep(df.withColumnRenamed("v", "hu"), windows, bins=4).collect()}
    for name, (lo, hi) in windows.items():
        scores = []
        for x, seg in zip(a, segs):
            label = flood(np.minimum(np.floor((np.clip(x, lo, hi) - lo) / (hi - lo) * 4), 3))
            scores.append(dice(np.isin(label, [i for i in np.unique(label) if (seg[label == i] == 2).mean() > 0.1]), seg == 2, True))
        assert np.isclose(got[name][0], np.mean(scores)) and got[name][1] == 2


def test_grouped_tumours_by_hand(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.random((6, 6, 6)), 2)
    label = np.arange(6)[:, None, None] // 2 * 4 + np.arange(6)[None, :, None] // 3 * 2 + np.arange(6)[None, None, :] // 3 + 1
    seg = np.zeros((6, 6, 6), int)
    seg[:2, :, :3], seg[4:, 3:, 3:], seg[2, 0, 5] = 2, 2, 1
    df, cases = volumes_of(spark, [v], [seg])
    cases = cases.withColumns({"dataset": F.lit("LiTS"), "sy": F.lit(2.0)})
    names = F.expr("x div 2 * 4 + y div 3 * 2 + z div 3 + 1").cast("long")
    held = df.withColumn("label", names)
    nodes = features.node_features(held, "v", cases)
    got = phenotype.group_tumours(held, nodes, features.label_counts(held), cases).collect()
    assert sorted(list(r.supernode_ids) for r in got) == [[1, 3], [12]]
    for r in got:
        inside = np.isin(label, list(r.supernode_ids))
        assert r.volume == inside.sum() and np.isclose(r.mean_intensity, v[inside].mean()) and np.isclose(r.intensity_std, v[inside].std())
        assert np.isclose(r.volume_cm3, inside.sum() * 2 / 1000) and r.boundary == edge(inside).sum()
        organ = np.argwhere(seg == 1) * [1, 2, 1]
        far = np.sqrt((((np.argwhere(inside) * [1, 2, 1])[:, None] - organ[None]) ** 2).sum(2)).min(1)
        assert np.isclose(r.distance_to_organ_mm, far.min()) and np.isclose(r.mean_distance_mm, far.mean())
        centres = [np.argwhere(label == i).mean(0) for i in r.supernode_ids]
        assert np.allclose(r.centroid, np.mean(centres, 0))


def test_region_dice_of_a_classifier(spark):
    rows = spark.createDataFrame([(0, 1, 1, 1), (0, 2, 1, 0), (0, 3, 0, 1), (1, 1, 0, 0)], "case_id long, label long, y int, argmax int")
    assert np.isclose(learn.supernode_dice(rows, F.col("argmax"), F.col("y")).first()[0], 2 * 1 / (2 + 2), atol=1e-6)


def test_strategies_that_fail_leave_a_row(spark):
    df, _ = volumes_of(spark, [np.zeros((2, 2, 2))], [np.zeros((2, 2, 2), int)])
    methods = {"ok": {"method": "quantized", "beta_min": 1}, "unknown": {"method": "kmeans"}, "fails on executors": {"method": "adaptive", "stride": 0}}
    got = {r.method: r for r in search.strategy_comparison(df, "v", methods).collect()}
    assert got["ok"].error is None and got["ok"].supernodes == 1
    assert "kmeans" in got["unknown"].error and got["fails on executors"].error and got["fails on executors"].case_id is None


def test_store_goes_on_where_it_stopped(spark, tmp_path):
    cases = spark.createDataFrame([(k,) for k in range(4)], "case_id long")
    asked = []

    def build(todo, factor=1, fail=False):
        asked.append(sorted(r.case_id for r in todo.collect()))
        rows = todo.crossJoin(spark.range(3).toDF("lin")).withColumn("v", F.col("case_id") * factor)
        return rows.withColumn("v", F.when(F.col("case_id") == 3, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v"))) if fail else rows

    store = lambda settings="a": volumes.Store(spark, str(tmp_path), settings)
    first = store().stage("s", cases.where("case_id < 2"), build)
    assert first.count() == 6 and asked == [[0, 1]]
    with pytest.raises(Exception, match="lost"):
        store().stage("s", cases, lambda todo: build(todo, fail=True))
    again = store()
    assert again.stage("s", cases, build).count() == 12 and asked[1:] == [[2, 3], [2, 3]] and again.built == {"s": 2}
    assert store().stage("s", cases, build).count() == 12 and len(asked) == 3
    other = {r.v for r in store("b").stage("s", cases, lambda todo: build(todo, 10)).collect()}
    assert other == {0, 10, 20, 30} and asked[3] == [0, 1, 2, 3]
    assert store().stage("none", cases, lambda todo: todo.withColumn("x", F.lit(1)).where("x > 1")).count() == 0
    assert store().stage("none", cases, lambda todo: 1 / 0).count() == 0  # finished without rows


def test_masks_written_again_change_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(c, i, i % 3) for c in range(3) for i in range(8)], "case_id long, lin long, pred int")
    for df in (rows, rows.where("case_id = 1"), rows):
        volumes.write_mask(df, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 24


def test_resumable_job_builds_once(spark, tmp_path):
    v, c = fixture.voxels(spark, SF), fixture.cases(spark, SF)
    s = pipelines.Settings((0, 200), "quantized", beta_min=5)
    first = pipelines.resumable_pipeline(v, c, str(tmp_path), s)
    scores = {r.case_id: r.dice for r in first["scores"].collect()}
    again = pipelines.resumable_pipeline(v, c, str(tmp_path), s)
    assert set(first["built"].values()) == {10} and set(again["built"].values()) == {0}
    assert {r.case_id: r.dice for r in again["scores"].collect()} == scores and len(scores) == 10
    # an oracle that chooses regions can't do worse than the classifier's choice on volumes of one region each
    truth = {r.case_id: r.dice for r in evaluate.oracle(first["counts"]).collect()}
    assert truth.keys() == scores.keys()


def test_a_stage_has_a_folder_for_each_attempt_not_for_each_case(spark, tmp_path):
    cases = spark.range(40).toDF("case_id")
    build = lambda todo: todo.withColumn("v", F.col("case_id") * 2)
    for asked in (cases.where("case_id < 30"), cases, cases):
        rows = volumes.Store(spark, str(tmp_path), "a").stage("s", asked, build)
    (stage,) = [p for p in tmp_path.iterdir() if p.name.count("-") == 1]
    assert len([p for p in stage.iterdir() if p.is_dir()]) == 2
    rows.withColumn("v", F.lit(-1).cast("long")).write.parquet(f"{stage}/attempt=lost")  # one that stopped before its manifest
    again = volumes.Store(spark, str(tmp_path), "a").stage("s", cases, lambda todo: 1 / 0)
    assert sorted(map(tuple, again.collect())) == [(k, 2 * k) for k in range(40)]


def test_strategies_write_tables_of_regions_only(spark, monkeypatch):
    df, _ = volumes_of(spark, [np.zeros((2, 2, 2))], [np.zeros((2, 2, 2), int)])
    written = []
    monkeypatch.setattr(search, "staged", lambda t: written.append(t.columns) or t)
    search.strategy_comparison(df, "v", {"ok": {"method": "quantized", "beta_min": 1}})
    assert written == [["case_id", "label", "n", "n_organ", "n_tumour"]]
