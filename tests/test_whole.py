"""Cases in one brick do in one crossing what cases over many bricks do by tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contract import table

from voxelgraph.operators import bricks, contract, features, phenotype, regions, search, whole
from voxelgraph.operators import edges as E
from voxelgraph.plans import pipelines
from voxelgraph.session import staged


def some(spark, rounded=None):
    rng = np.random.default_rng(31)
    a = [np.where(np.indices(s)[0] < s[0] // 2, 0.25, 0.7) + rng.normal(0, 0.1, s) for s in ((7, 6, 8), (4, 5, 3))]
    a = [x.clip(0, 1) if rounded is None else np.round(x.clip(0, 1), rounded) for x in a]
    df, cases = table(spark, *a)
    return df.where("lin % 13 <> 5").withColumn("v", F.when(F.col("lin") % 17 != 4, F.col("v"))).withColumn("seg", F.when(F.col("v") > 0.6, 2).otherwise((F.col("x") > 1).cast("int"))), cases


def both_ways(monkeypatch, found):
    monkeypatch.setattr(bricks, "SIDE", 1 << 10)
    one = found()
    monkeypatch.setattr(bricks, "SIDE", 4)
    return one, found()


def test_merged_and_refined_regions_are_those_over_many_bricks(spark, monkeypatch):
    df, _ = some(spark)
    merged = lambda: {(r.case_id, r.lin): r.label for r in contract.merged_contract(df, "v", 0.05, 0.08, 20, 60).collect()}
    one, many = both_ways(monkeypatch, merged)
    assert one == many and len(set(one.values())) > 5
    capped = {(r.case_id, r.lin): r.label for r in contract.anchored_contract(df, "v", 0.05, 0.08, 20).collect()}
    assert len(set(capped.values())) > len(set(one.values()))
    refined = lambda: {(r.case_id, r.lin): (r.mixed, r.grown) for r in contract.refined_watershed(df, "v", 0.05, 4, 9).collect()}
    one, many = both_ways(monkeypatch, refined)
    assert one == many and {m for m, _ in one.values()} == {True, False}


@pytest.mark.parametrize("measure", ["boundary", "volume"])
def test_a_search_of_cases_in_one_brick_writes_no_table(spark, monkeypatch, measure):
    df, _ = some(spark, 2)
    configs = spark.createDataFrame([(k, psi, 0.1, lo, 99, 0.1, 0.9) for k, (psi, lo) in enumerate((p, n) for p in (0.3, 0.26, 0.2) for n in (1, 5))], search.CONFIG)
    written, real = [], search.staged
    monkeypatch.setattr(search, "staged", lambda t: written.append(t.columns) or real(t))
    found = lambda: {(r.config_id, r.case_id): (round(r.dice, 9), r.supernodes, round(r.compression, 9)) for r in search.grid_search(df, "v", configs, measure=measure).collect()}
    monkeypatch.setattr(bricks, "SIDE", 1 << 10)
    one = found()
    assert not written and len(one) == 12
    monkeypatch.setattr(bricks, "SIDE", 4)
    assert found() == one and written


def test_equal_scores_tie_in_any_order_of_the_cases(spark):
    rows = [(k, case, d, 1, 1.0) for k, dice in enumerate(((0.3, 0.2, 0.1), (0.1, 0.2, 0.3))) for case, d in enumerate(dice)]
    scores = spark.createDataFrame(rows, "config_id int, case_id long, dice double, supernodes long, compression double").coalesce(1)
    assert search.best_config(search.search_log(scores, spark.createDataFrame([(0,), (1,)], "config_id int"))).first().config_id == 0


@pytest.mark.parametrize("method", contract.METHODS)
def test_counts_of_regions_are_those_of_the_voxels(spark, method):
    df, _ = some(spark)
    rows = lambda t: sorted((*r[:5], r[5] and round(r[5], 9)) for r in map(tuple, t.select("case_id", "label", "n", "n_organ", "n_tumour", "m").collect()))
    got = contract.region_counts(df, "v", method, 0.12, 0.1, 40, 6, 5)
    assert "Aggregate" not in got._jdf.queryExecution().analyzed().toString()
    assert rows(got) == rows(features.region_counts(contract.contracted(df, "v", method, 0.12, 0.1, 40, 6, 5), "v"))


def test_adjacency_and_means_come_from_one_crossing(spark, monkeypatch):
    df, _ = some(spark)
    named = df.withColumn("label", F.expr("case when lin % 11 = 0 then 0 else lin div 7 + 1 end").cast("long"))
    written, real = [], E.staged
    monkeypatch.setattr(E, "staged", lambda t: written.append(t.columns) or real(t))
    mean = {(r.case_id, r.label): r.mean for r in E.region_means(named, "v").collect()}
    faces = {(r.case_id, r.lo, r.hi): r.shared_faces for r in E.shared_faces(named).collect()}
    monkeypatch.setattr(bricks, "SIDE", 4)
    got = {(r.case_id, r.lo, r.hi): r for r in E.full_adjacency(named, "v").collect()}
    assert written == [["case_id", "lo", "hi", "n", "mean"]] and {k: r.shared_faces for k, r in got.items()} == faces
    assert all(abs(r.mean_diff - abs(mean[k[0], k[1]] - mean[k[0], k[2]])) < 1e-12 for k, r in got.items())


def test_hash_of_numbers_is_sparks(spark):
    a, b = np.array([1, -5, 1 << 40, 0]), np.array([7, 2, -9, 1 << 33])
    rows = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long").coalesce(1)
    assert [r.h for r in rows.select(F.xxhash64("a", "b").alias("h")).collect()] == regions.xxhash64(a, b).tolist()


def _same(got, want):
    key = [c for c in ("case_id", "label", "lo", "hi") if c in want.columns]
    a, b = ({tuple(r[c] for c in key): r.asDict() for r in t.select(want.columns).collect()} for t in (got, want))
    assert a.keys() == b.keys() and len(a) > 3
    flat = lambda r: [x for v in r.values() for x in (v if isinstance(v, list) else [v])]
    for k, row in a.items():
        for p, q in zip(flat(row), flat(b[k]), strict=True):
            assert p == q or p is not None and abs(p - q) <= 1e-9 * max(1, abs(q))


@pytest.mark.parametrize("side", [4, 1 << 10])
def test_one_crossing_gives_counts_features_faces_and_adjacency(spark, monkeypatch, side):
    df, cases = some(spark)
    labels = contract.labelled(df, "v", "adaptive", 0.12, 0.1, 3, 200, 0.1, 0.75, 6, 5)[1]
    if side > 4:
        rows = whole.region_rows(df, "v", "adaptive", 0.12, 0.1, 6, 5, (3, 200, 0.1, 0.75), True)
        near = {(r.case_id, r.lin): (r.x, r.y, r.z, r.seg, r.label) for r in rows.where("n is null").collect()}
        rows = rows.where("n is not null")
        chosen = {(r.case_id, r.label) for r in phenotype.select_tumour_nodes(features.label_counts(labels)).collect()}
        want = {(r.case_id, r.lin): (r.x, r.y, r.z, r.seg, r.label) for r in labels.collect() if r.seg == 1 or (r.case_id, r.label) in chosen}
        assert near == want and chosen and len(near) < df.count()
    else:
        monkeypatch.setattr(bricks, "SIDE", side)
        rows = features.region_rows(labels, "v")
    rows = staged(rows)
    _same(features.counts_of_rows(rows), features.label_counts(labels))
    _same(features.nodes_of_rows(rows, cases).drop("dominant_axis_vec"), features.node_features(labels, "v", cases).drop("dominant_axis_vec"))
    _same(features.faces_of_rows(rows), E.shared_faces(labels))
    _same(features.adjacency_of_rows(rows), E.full_adjacency(labels, "v"))


def test_jobs_that_need_no_voxels_write_none(spark, monkeypatch):
    df, cases = some(spark)
    df, written, real = df.withColumn("hu", F.col("v") * 100), [], pipelines.staged
    monkeypatch.setattr(pipelines, "staged", lambda t: written.append(t.columns) or real(t))
    s = pipelines.Settings((0, 100), beta_min=3, stride=5)
    m = pipelines.minors(df, cases, s, "none")
    assert written and not any("lin" in c for c in written)
    every = pipelines.minors(df, cases, s)
    _same(m["edge_features"], every["edge_features"])
    assert sorted(map(tuple, m["targets"].collect())) == sorted(map(tuple, every["targets"].collect()))
