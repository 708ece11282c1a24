from pyspark.sql import functions as F

from voxelgraph.llm import mixing


def test_raking_meets_the_marginals(spark):
    cells = [("a", "x", 100), ("a", "y", 300), ("b", "x", 400), ("b", "y", 200)]
    df = spark.createDataFrame(cells, "s string, l string, held long")
    targets = {"s": spark.createDataFrame([("a", 120.0), ("b", 180.0)], "s string, target double"), "l": spark.createDataFrame([("x", 150.0), ("y", 150.0)], "l string, target double")}
    w = {(r.s, r.l): r.weight for r in mixing.rake(df, targets, 20).collect()}
    by_hand = {(s, l): float(h) for s, l, h in cells}
    for _ in range(20):
        for k, t in ((0, {"a": 120, "b": 180}), (1, {"x": 150, "y": 150})):
            sums = {v: sum(x for c, x in by_hand.items() if c[k] == v) for v in t}
            by_hand = {c: x * t[c[k]] / sums[c[k]] for c, x in by_hand.items()}
    assert all(abs(w[c] - x) < 1e-3 for c, x in by_hand.items())
    assert abs(w["a", "x"] + w["a", "y"] - 120) < 0.01 and abs(w["a", "x"] + w["b", "x"] - 150) < 0.01


def test_sample_is_near_its_targets_and_repeatable(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.concat(F.lit("l"), F.col("id") % 2).alias("lang"), F.lit("t").alias("topic"), (F.col("id") % 5 + 1).alias("tokens"))
    out = mixing.calibrated(rows).cache()
    total, kept = out.agg(F.sum("tokens"), F.sum(F.expr("if(kept, tokens, 0)"))).first()
    assert abs(kept / total - 0.8) < 0.02
    share = {r.source: r.p for r in out.groupBy("source").agg(F.avg("probability").alias("p")).collect()}
    assert share["hot"] < min(p for s, p in share.items() if s != "hot")
    assert out.where("kept").exceptAll(mixing.calibrated(rows).where("kept")).count() == 0


def test_nulls_empty_texts_and_no_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None), (1, "", "s", "en"), (2, "abcd " * 9, None, "en"), (2, "abcd " * 9, None, "en")], "doc_id long, text string, source string, lang string")
    out = mixing.calibrated(mixing.measured(docs)).collect()
    assert len(out) == 4 and all(0 < r.probability <= 1 for r in out) and sum(r.probability == 1.0 for r in out) >= 2
    assert mixing.calibrated(mixing.measured(docs.limit(0))).count() == 0


def test_marginals_are_met_and_clashing_names_stay(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice("aab"), rng.choice(["en", "de", None]), rng.choice("pq"), rng.randrange(1, 400), "x", 7, "y") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long, probability string, c_source int, d string")
    cells = mixing.cells_of(df)
    targets = {d: mixing.marginal_targets(cells, d, 0.5, 0.7) for d in mixing.DIMENSIONS}
    off = mixing.achieved(mixing.rake(cells, targets), targets).collect()
    assert len(off) == 7 and max(r.off for r in off) < 1e-3
    one = mixing.achieved(mixing.rake(cells, targets, 1), targets).collect()
    assert max(r.off for r in off) <= max(r.off for r in one)
    out = mixing.calibrated(df, keep=0.5)
    assert set(out.columns) == {*df.columns, "kept"} and out.where("c_source <> 7 or d <> 'y'").count() == 0
    assert abs(out.where("kept").agg({"tokens": "sum"}).first()[0] / df.agg({"tokens": "sum"}).first()[0] - 0.5) < 0.05


def test_joined_sums_are_those_of_windows(spark, monkeypatch):
    rows = [(i, "abc"[i % 3], "de"[i % 2], "pq"[i % 5 % 2], i % 50) for i in range(400)]
    cells = mixing.cells_of(spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long"))
    targets = {d: mixing.marginal_targets(cells, d, 0.8, 0.7) for d in mixing.DIMENSIONS}
    key = lambda r: (r.source, r.lang, r.topic)
    window = {key(r): r.weight for r in mixing.rake(cells, targets).collect()}
    monkeypatch.setattr(mixing, "CELLS", 0)
    assert {key(r): r.weight for r in mixing.rake(cells, targets).collect()} == window


def test_very_long_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "| " * 200_000, "s", "en"), (2, "", "s", "en"), (3, None, None, None)], "doc_id long, text string, source string, lang string")
    rows = {r.doc_id: (r.topic, r.tokens) for r in mixing.measured(docs).collect()}
    assert rows == {1: ("table", 100_000), 2: ("prose", 0), 3: ("prose", 0)}
    assert mixing.calibrated(mixing.measured(docs)).count() == 3 and mixing.calibrated(mixing.measured(docs.limit(0))).count() == 0
