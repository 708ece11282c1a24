"""Classification of regions with Spark ML, message features and threshold sweeps."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgraph.operators.evaluate import EPS


def class_weights(targets: DataFrame, mode: str = "sqrt") -> tuple[float, float]:
    """Weights of classes 0 and 1: 1 and min(sqrt(neg / pos), 30) (``sqrt``) or neg / pos (``raw``); 1 and 1 without positives."""
    n, pos = targets.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not pos:
        return 1.0, 1.0
    ratio = (n - pos) / pos
    return 1.0, min(ratio**0.5, 30.0) if mode == "sqrt" else ratio


def class_balance(targets: DataFrame) -> DataFrame:
    """Positive and negative regions and their ratio, over all cases."""
    pos, neg = F.sum("y"), F.sum(1 - F.col("y"))
    return targets.agg(pos.alias("positive"), neg.alias("negative"), (neg / F.greatest(pos, F.lit(1))).alias("ratio"))


def message_aggregate(nodes: DataFrame, edges: DataFrame, weights: list[list[float]] | None = None, column: str = "features") -> DataFrame:
    """``(case_id, idx, message)``: sum over incoming edges of relu(x_src + projected edge attributes).

    ``weights`` projects attributes to the node width (a row for each node feature); None adds nothing. A
    graph without edges gets self-loops without attributes; other isolated nodes get zeros.
    """
    width = nodes.select(F.size(column)).first()
    d = width[0] if width else 0
    x = nodes.select("case_id", F.col("idx").alias("src"), F.col(column).alias("x"))
    if weights is None:
        moved = lambda: F.col("x")
    else:
        moved = lambda: F.array(*(F.col("x")[k] + sum((F.col("attr")[j] * w for j, w in enumerate(row)), F.lit(0.0)) for k, row in enumerate(weights)))
    sent = edges.join(x, ["case_id", "src"]).select("case_id", F.col("dst").alias("idx"), F.transform(moved(), lambda v: F.greatest(v, F.lit(0.0))).alias("m"))
    lonely = nodes.join(edges.select("case_id").distinct(), "case_id", "left_anti").select("case_id", "idx", F.transform(column, lambda v: F.greatest(v, F.lit(0.0))).alias("m"))
    sums = sent.unionByName(lonely).groupBy("case_id", "idx").agg(*(F.sum(F.col("m")[k]).alias(f"s{k}") for k in range(d)))
    return nodes.select("case_id", "idx").join(sums, ["case_id", "idx"], "left").select("case_id", "idx", F.array(*(F.coalesce(f"s{k}", F.lit(0.0)) for k in range(d))).alias("message"))


def khop_features(nodes: DataFrame, edges: DataFrame, k: int = 3, weights: list[list[float]] | None = None) -> DataFrame:
    """``nodes`` with ``features`` followed by the messages of k rounds."""
    out, current = nodes.withColumn("all", F.col("features")), nodes
    for _ in range(k):
        m = message_aggregate(current, edges, weights)
        current = current.drop("features").join(m.withColumnRenamed("message", "features"), ["case_id", "idx"])
        out = out.join(current.select("case_id", "idx", F.col("features").alias("__m")), ["case_id", "idx"]).withColumn("all", F.concat("all", "__m")).drop("__m")
    return out.drop("features").withColumnRenamed("all", "features")


def classifiers(seed: int = 42) -> dict[str, object]:
    common = {"featuresCol": "v", "labelCol": "y", "weightCol": "w"}
    return {
        "logistic": LogisticRegression(maxIter=50, regParam=1e-4, **common),
        "forest": RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed, **common),
        "gbt": GBTClassifier(maxIter=20, maxDepth=4, seed=seed, **common),
    }


def _vectors(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("v", array_to_vector("features"))


def fit(nodes: DataFrame, model: str = "logistic", mode: str = "sqrt", seed: int = 42) -> PipelineModel:
    """One weighted binary classifier on ``features`` and ``y``."""
    w0, w1 = class_weights(nodes, mode)
    rows = _vectors(nodes).withColumn("w", F.when(F.col("y") == 1, w1).otherwise(w0))
    return Pipeline(stages=[classifiers(seed)[model]]).fit(rows)


def predict_probability(model: PipelineModel, nodes: DataFrame) -> DataFrame:
    """Add ``p``, the probability of class 1, and ``argmax``."""
    out = model.transform(_vectors(nodes))
    return out.select(*nodes.columns, vector_to_array("probability")[1].alias("p"), F.col("prediction").cast("int").alias("argmax"))


def supernode_dice(rows: DataFrame, pred: Column, y: Column) -> DataFrame:
    """One row: Dice over all regions together."""
    tp, fp, fn = (F.sum(c.cast("bigint")) for c in ((pred == 1) & (y == 1), (pred == 1) & (y == 0), (pred == 0) & (y == 1)))
    return rows.agg((2 * tp / (2 * tp + fp + fn + EPS)).alias("dice"))


def train_node_classifier(train: DataFrame, validation: DataFrame, models: tuple[str, ...] = ("logistic", "forest"), mode: str = "sqrt") -> tuple[str, PipelineModel]:
    """Train each model on ``train`` and keep the one with the best Dice on ``validation`` (the first, on a tie)."""
    best = None
    for name in models:
        model = fit(train, name, mode)
        d = supernode_dice(predict_probability(model, validation), F.col("argmax"), F.col("y")).first()[0] or 0.0
        if best is None or d > best[0]:
            best = (d, name, model)
    return best[1], best[2]


def threshold_sweep(scored: DataFrame, counts: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: voxel Dice, recall and precision pooled over all cases, and whether it is the first best.

    ``scored`` has ``p`` for each region. Regions meet every threshold inside one aggregate: no voxels and no join
    with the thresholds.
    """
    j = counts.join(scored.select("case_id", "label", "p"), ["case_id", "label"], "left")
    sums = [f for k, t in enumerate(thresholds) for f in (F.sum(F.when(F.col("p") >= t, F.col("n_tumour")).otherwise(0)).alias(f"b{k}"), F.sum(F.when(F.col("p") >= t, F.col("n")).otherwise(0)).alias(f"p{k}"))]
    rows = j.agg(F.sum("n_tumour").alias("gt"), *sums).select("gt", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("threshold"), F.col(f"b{k}").alias("both"), F.col(f"p{k}").alias("pred")) for k, t in enumerate(thresholds)))).alias("x")).select("gt", "x.*")
    scores = rows.select("k", "threshold", (2.0 * F.col("both") / (F.col("gt") + F.col("pred") + EPS)).alias("dice"), F.when(F.col("gt") > 0, F.col("both") / F.col("gt")).otherwise(0.0).alias("recall"), F.when(F.col("pred") > 0, F.col("both") / F.col("pred")).otherwise(0.0).alias("precision"))
    top = scores.agg(F.max(F.struct("dice", (-F.col("k")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("best"))
    return scores.crossJoin(F.broadcast(top)).select("threshold", "dice", "recall", "precision", (F.col("k") == F.col("best")).alias("best"))  # one row
