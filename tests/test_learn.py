import numpy as np
from pyspark.sql import functions as F

from voxelgraph.operators import evaluate, learn, phenotype, search


def graph(spark):
    nodes = [(0, 0, [1.0, -2.0]), (0, 1, [0.5, 3.0]), (0, 2, [2.0, 2.0]), (1, 0, [-1.0, 4.0])]
    edges = [(0, 0, 1, [1.0]), (0, 1, 0, [1.0])]
    return spark.createDataFrame(nodes, "case_id long, idx long, features array<double>"), spark.createDataFrame(edges, "case_id long, src long, dst long, attr array<double>")


def test_messages_self_loops_and_isolated_nodes(spark):
    nodes, edges = graph(spark)
    got = {(r.case_id, r.idx): list(r.message) for r in learn.message_aggregate(nodes, edges, [[0.5], [1.0]]).collect()}
    assert got == {(0, 0): [1.0, 4.0], (0, 1): [1.5, 0.0], (0, 2): [0.0, 0.0], (1, 0): [0.0, 4.0]}
    hops = {(r.case_id, r.idx): list(r.features) for r in learn.khop_features(nodes, edges, 2).collect()}
    assert hops[0, 0] == [1.0, -2.0, 0.5, 3.0, 1.0, 0.0] and len(hops[1, 0]) == 6


def test_class_weights(spark):
    y = lambda *v: spark.createDataFrame([(x,) for x in v], "y int")
    assert learn.class_weights(y(1, 0, 0, 0, 0)) == (1.0, 2.0) and learn.class_weights(y(0, 0)) == (1.0, 1.0)
    assert learn.class_weights(y(1, 0, 0, 0, 0), "raw") == (1.0, 4.0)


def test_classifier_separates(spark):
    rng = np.random.default_rng(0)
    rows = [(0, i, [float(v) for v in rng.normal(2 * (i % 4 == 0), 0.3, 3)], int(i % 4 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "case_id long, label long, features array<double>, y int")
    name, model = learn.train_node_classifier(df, df, ("logistic",))
    scored = learn.predict_probability(model, df).collect()
    assert name == "logistic" and all(r.argmax == r.y and 0 <= r.p <= 1 for r in scored)


def test_empty_truth_has_two_rules(spark):
    counts = spark.createDataFrame([(0, 1, 10, 0, 0), (1, 1, 10, 5, 5), (1, 0, 4, 1, 1)], "case_id long, label long, n long, n_organ long, n_tumour long")
    agree = {r.case_id: r.dice for r in evaluate.count_scores(counts, F.lit(True)).collect()}
    one = {r.case_id: r.dice for r in evaluate.count_scores(counts, F.lit(True), "one").collect()}
    assert agree[0] == 0.0 and one[0] == 1.0 and abs(agree[1] - 2 * 5 / 16) < 1e-6
    assert {r.case_id: r.lost for r in evaluate.deletion_loss(counts).collect()} == {0: 0, 1: 1}


def test_distances_against_brute_force(spark):
    rng = np.random.default_rng(4)
    seg = rng.choice([0, 0, 0, 0, 1, 2], (5, 6, 4))
    rows = [(0, x, y, z, int((x * 6 + y) * 4 + z), int(seg[x, y, z])) for x, y, z in np.ndindex(seg.shape)]
    df = spark.createDataFrame(rows, "case_id long, x int, y int, z int, lin long, seg int")
    cases = spark.createDataFrame([(0, 1.0, 1.5, 2.5)], "case_id long, sx double, sy double, sz double")
    got = {r.lin: r.distance for r in phenotype.distance_to_mask(df, F.col("seg") == 2, F.col("seg") == 1, cases).collect()}
    organ = np.argwhere(seg == 1) * [1.0, 1.5, 2.5]
    for p in np.argwhere(seg == 2):
        want = np.sqrt(((organ - p * [1.0, 1.5, 2.5]) ** 2).sum(1)).min()
        assert abs(got[int((p[0] * 6 + p[1]) * 4 + p[2])] - want) < 1e-9


def test_grids_and_best_configurations(spark):
    grid = search.param_grid(spark, 0.0, 1.0, 3, 2, 2).orderBy("config_id").collect()
    assert len(grid) == 12 and abs(grid[0].psi - 0.02) < 1e-12 and grid[1].beta_min == int(10**3.5) and abs(grid[-1].alpha - 0.5) < 1e-12
    assert search.param_grid(spark, 0.0, 1.0, 20, 10, 8, skip=True, second=True).where("alpha < psi").count() == 0
    drawn = search.random_search(spark, 50).collect()
    assert all(0.02 <= r.psi <= 0.2 and 1 <= r.beta_min <= 200 and 2000 <= r.beta_max <= 50_000 and 0 <= r.m_min <= 0.15 for r in drawn)
    log = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "config_id int, score double")
    assert search.best_config(log).first().config_id == 1 and [r.config_id for r in search.top_configs(log, 2).collect()] == [1, 2]
