"""Lifting of region classes to voxels, and scores.

Nearly all scores come from the table of counts per label, not from voxels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgraph.operators import bricks

EPS = 1e-8


def lift(labelled: DataFrame, classes: DataFrame, column: str = "pred") -> DataFrame:
    """Each voxel gets its region's class; deleted voxels and regions without a class get 0."""
    named = classes.where("label > 0").select("case_id", "label", F.col(column).alias("__c"))
    return labelled.join(named, ["case_id", "label"], "left").withColumn(column, F.coalesce("__c", F.lit(0)).cast("int")).drop("__c")


def dice_of(both: Column, gt: Column, pred: Column, empty: str = "agree") -> Column:
    """2 both / (gt + pred + eps). Without truth: ``agree``: 1 if the prediction is empty too, else 0; ``one``: 1."""
    usual = 2.0 * both / (gt + pred + EPS)
    return F.when(gt == 0, F.when((pred == 0) | F.lit(empty == "one"), 1.0).otherwise(0.0)).otherwise(usual)


def _scored(sums: DataFrame, empty: str) -> DataFrame:
    both, gt, pred = F.col("n_both"), F.col("n_gt"), F.col("n_pred")
    return sums.withColumns({"dice": dice_of(both, gt, pred, empty), "recall": F.when(gt > 0, both / gt).otherwise(0.0), "precision": F.when(pred > 0, both / pred).otherwise(0.0)})


def mask_scores(voxels: DataFrame, pred: Column, truth: Column, empty: str = "agree") -> DataFrame:
    """Dice, recall and precision per case of two voxel masks."""
    n = lambda c: F.sum(c.cast("bigint"))
    return _scored(voxels.groupBy("case_id").agg(n(pred & truth).alias("n_both"), n(truth).alias("n_gt"), n(pred).alias("n_pred")), empty)


def count_scores(counts: DataFrame, chosen: Column, empty: str = "agree") -> DataFrame:
    """The same when whole regions are chosen, from ``label_counts``."""
    pick = lambda c: F.sum(F.when(chosen & (F.col("label") > 0), F.col(c)).otherwise(0))
    return _scored(counts.groupBy("case_id").agg(pick("n_tumour").alias("n_both"), F.sum("n_tumour").alias("n_gt"), pick("n").alias("n_pred")), empty)


def share(threshold: float) -> Column:
    """Tumour share of a region above a threshold (strictly)."""
    return F.col("n_tumour") / F.col("n") > threshold


def oracle(counts: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Scores if exactly the regions with a tumour share over the threshold were chosen, and how many there are."""
    regions = counts.groupBy("case_id").agg(F.sum((share(threshold) & (F.col("label") > 0)).cast("bigint")).alias("tumour_supernodes"))
    return count_scores(counts, share(threshold)).join(regions, "case_id")


def deletion_loss(counts: DataFrame) -> DataFrame:
    """Tumour voxels in deleted regions, and their share of all in percent."""
    sums = counts.groupBy("case_id").agg(F.sum(F.when(F.col("label") == 0, F.col("n_tumour")).otherwise(0)).alias("lost"), F.sum("n_tumour").alias("n_gt"))
    return sums.withColumn("lost_pct", F.when(F.col("n_gt") > 0, 100.0 * F.col("lost") / F.col("n_gt")).otherwise(0.0))


def volume_dice(counts: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Dice of the tumour regions' mask; 1 without truth."""
    return count_scores(counts, share(threshold), "one").select("case_id", "dice")


def surface_signatures(labelled: DataFrame, side: int = 0) -> DataFrame:
    """``(case_id, label, beside, edge, n)``: how many voxels of a label have the same other labels for face neighbours.

    ``beside``: those labels, ascending, -1 being the outside; ``edge``: on the surface of the truth. A voxel is on the
    surface of a choice of regions if its label is chosen and one beside it isn't, so the surface of any choice is
    a sum over this table: no voxel is read again.
    """

    def work(brick: bricks.Brick):
        label, truth, own = brick.array(0, -1), brick.array(1, False), brick.voxels()
        edge = bricks.surface(truth)[0]
        near = np.full((6, *label.shape), -1, "i8")
        for k, (lo, hi) in enumerate(bricks.faces()):
            near[2 * k][lo], near[2 * k + 1][hi] = label[hi], label[lo]
        near = np.sort(np.where(near == label, np.iinfo("i8").max, near)[:, own], axis=0)  # its own label doesn't count
        near[1:][near[1:] == near[:-1]] = np.iinfo("i8").max
        rows = np.concatenate([label[own][None], edge[own][None].astype("i8"), np.sort(near, axis=0)])
        able = (near < np.iinfo("i8").max).any(0) | edge[own]
        found, n = np.unique(rows[:, able], axis=1, return_counts=True)
        beside = [[int(x) for x in c if x < np.iinfo("i8").max] for c in found[2:].T]
        return found[0], beside, found[1].astype(bool), n

    parts = bricks.from_bricks(labelled, [F.col("label").cast("bigint"), F.coalesce(F.col("seg") == 2, F.lit(False))], work, "label bigint, beside array<bigint>, edge boolean, n bigint", side)
    return parts.groupBy("case_id", "label", "beside", "edge").agg(F.sum("n").alias("n"))


def surface_scores(signatures: DataFrame, choices: DataFrame) -> DataFrame:
    """``(case_id, choice, dice)``: Dice of each choice's surface and the truth's; 1 without truth.

    ``choices``: ``case_id, choice, labels`` (an array of regions above 0, which may be empty). A case's choices meet its
    signatures, both tables of regions.
    """
    held = choices.join(signatures, "case_id", "left")
    on = F.array_contains("labels", F.col("label")) & (F.size(F.array_except("beside", "labels")) > 0)
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = held.groupBy("case_id", "choice").agg(count(on & F.col("edge")).alias("both"), count(F.col("edge")).alias("gt"), count(on).alias("pred"))
    return sums.select("case_id", "choice", dice_of(F.col("both"), F.col("gt"), F.col("pred"), "one").alias("dice"))


def boundary_dice(labelled: DataFrame, counts: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Dice between the surface of the tumour regions and the surface of the truth; 1 without truth."""
    chosen = counts.groupBy("case_id").agg(F.collect_list(F.when(share(threshold) & (F.col("label") > 0), F.col("label").cast("bigint"))).alias("labels"))
    return surface_scores(surface_signatures(labelled), chosen.withColumn("choice", F.lit(0))).select("case_id", "dice")


def tumour_capture(counts: DataFrame, beta_min: int = 1, threshold: float = 0.1) -> DataFrame:
    """Percent of the tumour inside tumour regions of ``beta_min`` voxels or more; label 0 counts as a region here."""
    ok = share(threshold) & (F.col("n") >= beta_min)
    return counts.groupBy("case_id").agg((100.0 * F.sum(F.when(ok, F.col("n_tumour")).otherwise(0)) / F.greatest(F.sum("n_tumour"), F.lit(1))).alias("capture_pct"))


def three_class(counts: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``(case_id, label, pred)``: 2 for a tumour share over the threshold, else 1 for an organ share, else 0; label 0 too."""
    organ = (F.col("n_organ") - F.col("n_tumour")) / F.col("n") > threshold
    return counts.select("case_id", "label", F.when(share(threshold), 2).when(organ, 1).otherwise(0).alias("pred"))


def three_class_mask(labelled: DataFrame, counts: DataFrame, threshold: float = 0.1) -> DataFrame:
    return labelled.join(three_class(counts, threshold), ["case_id", "label"])


def class_dice(masked: DataFrame) -> DataFrame:
    """Tumour and organ Dice of a three-class mask, per case."""
    t = mask_scores(masked, F.col("pred") == 2, F.col("seg") == 2).select("case_id", F.col("dice").alias("tumour_dice"))
    o = mask_scores(masked, F.col("pred") == 1, F.col("seg") == 1).select("case_id", F.col("dice").alias("organ_dice"))
    return t.join(o, "case_id")


def class_dice_of_counts(counts: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``class_dice`` of the ``three_class_mask``, from the table of counts: whole regions have one class."""
    of = counts.join(three_class(counts, threshold), ["case_id", "label"]).withColumn("organ", F.col("n_organ") - F.col("n_tumour"))
    out = []
    for k, (truth, name) in {2: ("n_tumour", "tumour_dice"), 1: ("organ", "organ_dice")}.items():
        pick = lambda c, k=k: F.sum(F.when(F.col("pred") == k, F.col(c)).otherwise(0))
        out.append(dice_of(pick(truth), F.sum(truth), pick("n")).alias(name))
    return of.groupBy("case_id").agg(*out)


def split_summary(scores: DataFrame, splits: DataFrame) -> DataFrame:
    """Mean, median and population deviation of Dice, mean recall and precision, per split and over all (null split)."""
    return scores.join(splits, "case_id").rollup("split").agg(
        F.count("*").alias("cases"),
        F.avg("dice").alias("mean_dice"),
        F.percentile("dice", F.lit(0.5)).alias("median_dice"),
        F.stddev_pop("dice").alias("std_dice"),
        F.avg("recall").alias("mean_recall"),
        F.avg("precision").alias("mean_precision"),
    )
