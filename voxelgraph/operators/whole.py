"""Contractions of cases that lie in one brick: what bricks do step by step is done in one task for each case.

Nothing leaves such a brick, so no step needs the tables of borders and parts of the step before it, and voxels cross
to Python once. Cases over several bricks go by ``regions``; both give the same labels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgraph.functions import scalars
from voxelgraph.operators import bricks, features, growth, regions
from voxelgraph.operators.bricks import AXES, Brick
from voxelgraph.session import staged

EPS = 1e-8
#: Added to a place that is a marker of the second watershed, above all labels of the first.
FINE = 1 << 32


def by_extent(voxels: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(cases that lie in one brick, the others or None); voxels are read once to tell, and parted only where both occur."""
    wide = staged(voxels.where(F.greatest(*AXES) >= bricks.SIDE).select("case_id").distinct())
    if wide.isEmpty():
        return voxels, None
    return voxels.join(wide, "case_id", "left_anti"), voxels.join(wide, "case_id", "left_semi")


def quantized(brick: Brick, k: int) -> np.ndarray:
    """Components of equal keys, the k-th input; a null key has label 0."""
    first = regions.linked_parts(brick.array(k, 0), brick.valid(k), 0)
    return np.where(first < 0, 0, brick.array(0, 0).ravel()[first] + 1)


def _refined(brick: Brick, coarse: np.ndarray, gradient: np.ndarray, lin: np.ndarray, value: np.ndarray, psi: float, step: int, least: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(which voxels lie in mixed regions, the finer watershed inside these); None without a fine marker."""
    held, valid = brick.voxels(), brick.valid(1)
    names, of, n = np.unique(coarse[held], return_inverse=True, return_counts=True)
    v, some = value[held], valid[held]
    count = np.bincount(of, some, len(names))
    off = np.where(some, v - (np.bincount(of, np.where(some, v, 0.0), len(names)) / np.maximum(count, 1))[of], 0.0)
    deviation = np.sqrt(np.bincount(of, off * off, len(names)) / np.maximum(count, 1))
    flagged = (count > 0) & (n > least) & ~(deviation <= 0.4 * psi)  # NaN is larger than any number, as in SQL
    mixed = np.zeros(held.shape, bool)
    mixed[held] = flagged[of]
    fine = mixed & _lattice(brick, step)
    if not fine.any():
        return None
    return mixed, regions.forest_of(gradient, np.where(~mixed, coarse, np.where(fine, lin + FINE, 0)), lin, held)[1]


def _lattice(brick: Brick, step: int) -> np.ndarray:
    on = [(np.arange(m) + f) % step == 0 for m, f in zip(brick.shape, brick.first, strict=True)]
    return on[0][:, None, None] & on[1][None, :, None] & on[2][None, None, :]


def adaptive(brick: Brick, psi: float, step: int, least: int) -> np.ndarray:
    """Coarse watershed, refined and split by intensity where a region is mixed. Inputs: lin, value, marker, bin."""
    lin, value, marker, bin_ = (brick.array(k, empty) for k, empty in ((0, -1), (1, np.nan), (2, 0), (3, -2)))
    held = brick.voxels()
    gradient = np.where(held, bricks.sobel(value), np.nan)
    coarse = regions.forest_of(gradient, marker, lin, held)[1]
    finer = _refined(brick, coarse, gradient, lin, value, psi, step, least)
    if finer is None:
        return coarse
    mixed, grown = finer
    # a number for each pair of region and bin
    key = np.unique(grown, return_inverse=True)[1].reshape(grown.shape) * (int(bin_.max()) + 4) + np.where(mixed, bin_, -1) + 2
    return lin.ravel()[regions.linked_parts(key, held, 0)] + 1


def refined(voxels: DataFrame, value: str, psi: float, coarse: int, step: int, least: int = 30) -> DataFrame:
    """``voxels`` with ``mixed`` and ``grown``: a watershed from every ``coarse``-th voxel, finer inside mixed regions."""

    def run(brick: Brick):
        lin, v, held = brick.array(0, -1), brick.array(1, np.nan), brick.voxels()
        gradient, on = np.where(held, bricks.sobel(v), np.nan), held & _lattice(brick, coarse)
        first = regions.forest_of(gradient, np.where(on, np.cumsum(on).reshape(on.shape), 0), lin, held)[1]
        return _refined(brick, first, gradient, lin, v, psi, step, least) or (np.zeros(held.shape, bool), first)

    return bricks.on_bricks(voxels, [_as(voxels, "lin", "bigint"), _as(voxels, value, "double")], run, "mixed boolean, grown bigint", halo=False)


def anchored(brick: Brick, tolerance: float, most: int | None) -> np.ndarray:
    """The place of the seed that each voxel's region grows from, + 1; 0 without a value. Inputs: lin, value."""
    lin, value = brick.array(0, -1), brick.array(1, np.nan)
    held = brick.voxels() & ~np.isnan(value)
    if not held.any():
        return np.zeros(held.shape, "i8")
    seeds = np.flatnonzero(held)[growth.seed_order([c + f for c, f in zip(np.nonzero(held), brick.first, strict=True)])]
    owner = growth.by_queue(value, held, seeds, tolerance, most)
    return np.where(owner < 0, 0, lin.ravel()[owner] + 1)


def merged(brick: Brick, label: np.ndarray, alpha: float, most: int) -> np.ndarray:
    """Regions after ``regions.merged``, of the values that the second input has."""
    held = brick.voxels() & (label > 0)
    lo, hi, _ = bricks.face_pairs(brick, label)
    names, of, n = np.unique(label[held], return_inverse=True, return_counts=True)
    total = np.bincount(of, np.where(brick.valid(1), brick.array(1, 0.0), 0.0)[held], len(names))
    out = np.zeros(label.shape, "i8")
    out[held] = regions.merged_within(names, n, total, np.searchsorted(names, lo), np.searchsorted(names, hi), alpha, most)[of]
    return out


def kept(brick: Brick, label: np.ndarray, value: int, bounds: tuple[int, int, float, float]) -> np.ndarray:
    """1, 2, ... for the labels above 0 whose voxels and mean lie within the bounds, in order; 0 for all others."""
    held = brick.voxels() & (label > 0)
    some, out = brick.valid(value)[held], np.zeros(label.shape, "i8")
    names, of, n = np.unique(label[held], return_inverse=True, return_counts=True)
    count = np.bincount(of, some, len(names))
    mean = np.bincount(of, np.where(some, brick.array(value, np.nan)[held], 0.0), len(names)) / np.maximum(count, 1)
    fits = (count > 0) & (n >= bounds[0]) & (n <= bounds[1]) & (mean >= bounds[2]) & (mean <= bounds[3])
    out[held] = np.where(fits, np.cumsum(fits), 0)[of]
    return out


def _as(voxels: DataFrame, name: str, kind: str) -> Column | str:
    """A column of that type; by its name if it has it, so that it crosses to Python once."""
    return name if dict(voxels.dtypes)[name] == kind else F.col(name).cast(kind)


def _way(voxels: DataFrame, value: str, method: str, psi: float, alpha: float, most: int | None, bins: int, stride: int, least: int = 30, together: int = 0) -> tuple[list[Column | str], Callable[[Brick], np.ndarray]]:
    """(inputs, the labels of a brick) of a method; the first inputs are lin and value."""
    base = [_as(voxels, "lin", "bigint"), _as(voxels, value, "double")]
    if method == "quantized":
        return [*base, scalars.quantize(F.col(value), bins)], lambda brick: quantized(brick, 2)
    tolerance = max(psi, alpha)
    if method == "anchored":
        return base, lambda brick: anchored(brick, tolerance, most)
    if method == "anchored_capped":
        return base, lambda brick: merged(brick, anchored(brick, tolerance, most), alpha, together)
    on = [F.col(a) % stride == 0 for a in AXES]
    marker = F.coalesce(F.when(on[0] & on[1] & on[2], F.col("lin") + 1), F.lit(0)).cast("bigint")
    step = max(3, stride // 3)
    return [*base, marker, scalars.quantize(F.col(value), scalars.psi_bins(psi)).cast("bigint")], lambda brick: adaptive(brick, psi, step, least)


def contracted(voxels: DataFrame, value: str, method: str, psi: float, alpha: float, most: int | None, bins: int, stride: int, bounds: tuple[int, int, float, float] | None = None, together: int = 0) -> DataFrame:
    """``voxels`` with ``label`` by a method of ``contract.contracted``, for cases that lie in one brick.

    bounds: sizes and means that regions must have; then also ``kept``, their labels after the others' deletion.
    """
    inputs, work = _way(voxels, value, method, psi, alpha, most, bins, stride, together=together)

    def run(brick: Brick):
        label = work(brick)
        return (label, kept(brick, label, 1, bounds)) if bounds else label

    return bricks.on_bricks(voxels, inputs, run, "label bigint" + ", kept bigint" * bool(bounds), halo=False)


def counted(voxels: DataFrame, value: str, method: str, psi: float, alpha: float, most: int | None, bins: int, stride: int, together: int = 0) -> DataFrame:
    """``features.region_counts`` of ``contracted``: regions, not voxels, come back from Python."""
    inputs, work = _way(voxels, value, method, psi, alpha, most, bins, stride, together=together)
    n = len(inputs)

    def run(brick: Brick):
        label, held = work(brick), brick.voxels()
        names, of, size = np.unique(label[held], return_inverse=True, return_counts=True)
        count = lambda w: np.bincount(of, w, len(names))
        seg, some = brick.array(n, 0)[held], brick.valid(1)[held]
        valid = count(some)
        with np.errstate(invalid="ignore"):
            mean = count(np.where(some, brick.array(1, 0.0)[held], 0.0)) / valid
        return names, size, count(seg >= 1).astype("i8"), count(seg == 2).astype("i8"), pa.array(mean, mask=valid == 0)

    return bricks.from_bricks(voxels, [*inputs, "seg"], run, "label bigint, n bigint, n_organ bigint, n_tumour bigint, m double", halo=False)


def region_rows(voxels: DataFrame, value: str, method: str, psi: float, alpha: float, bins: int, stride: int, bounds: tuple[int, int, float, float], around: bool, threshold: float = 0.1) -> DataFrame:
    """``features.region_rows`` of ``contracted`` after the deletion of regions outside the bounds.

    around: also, with a null ``n``, the voxels of the organ and of regions with a tumour share over the threshold:
    ``x, y, z, lin, seg``, in which distances of tumours and their shapes are measured.
    """
    inputs, work = _way(voxels, value, method, psi, alpha, None, bins, stride)
    n = len(inputs)

    def run(brick: Brick):
        label = kept(brick, work(brick), 1, bounds)
        seg, held = brick.array(n, 0), brick.voxels()
        rows = features.brick_rows(brick, label, brick.array(1, np.nan), brick.valid(1), seg)
        if not around:
            return rows
        names, of, size = np.unique(label, return_inverse=True, return_counts=True)
        of = of.reshape(label.shape)
        size, tumour = np.bincount(of[held], minlength=len(names)), np.bincount(of[held], (seg == 2)[held], len(names))
        near = held & ((seg == 1) | ((names > 0) & (tumour / np.maximum(size, 1) > threshold))[of])
        at = [c + f for c, f in zip(np.nonzero(near), brick.first, strict=True)]
        regions_, voxels_ = len(rows[0]), len(at[0])
        out = [pa.concat_arrays([pa.array(c), pa.nulls(voxels_, pa.array(c).type)]) for c in rows[1:]]
        more = [pa.concat_arrays([pa.nulls(regions_, t), pa.array(c, t)]) for c, t in zip([*at, brick.array(0, -1)[near], seg[near]], [pa.int32()] * 3 + [pa.int64(), pa.int32()], strict=True)]
        return [np.concatenate([rows[0], label[near]]), *out, *more]

    return bricks.from_bricks(voxels, [*inputs, _as(voxels, "seg", "int")], run, features.ROWS + ", x int, y int, z int, lin bigint, seg int" * around, halo=False)


def searched(voxels: DataFrame, value: str, ways: dict[int, dict[tuple, list[int]]], boundary: bool, kind: str, threshold: float = 0.1) -> DataFrame:
    """``(case_id, config_id, dice, supernodes, voxels)``: quantised contractions of each case, scored where they are made.

    ``ways``: for each number of bins the bounds (sizes, means) to score and the configurations that have them. A
    case crosses to Python once for all of them; no label and no table of regions leaves the task.
    """

    def run(brick: Brick):
        v, truth, rows = brick.array(0, np.nan), brick.array(1, False), []
        held, edge = brick.voxels(), bricks.surface(truth)[0]
        some, own = brick.valid(0)[held], truth[held]
        value = np.where(some, v[held], 0.0)
        for bins, asked in ways.items():
            bin_ = np.clip(np.nan_to_num(np.floor(v * bins)), 0, bins - 1)  # without a value 0, as scalars.quantize
            names, of, n = np.unique(regions.linked_parts(bin_, held, 0)[held], return_inverse=True, return_counts=True)
            tumour = np.bincount(of, own, len(names)).astype("i8")
            with np.errstate(invalid="ignore"):
                mean = np.bincount(of, value, len(names)) / np.bincount(of, some, len(names))
            found = {}
            for (low, high, least, most), ids in asked.items():
                kept = (n >= low) & (n <= high) & (mean >= least) & (mean <= most)
                pick = kept & (tumour / n > threshold)
                if (key := pick.tobytes()) not in found:
                    if boundary:
                        mask = np.zeros(held.shape, bool)
                        mask[held] = pick[of]
                        on = bricks.surface(mask)[0]
                        both, gt, pred = (int(c.sum()) for c in (on & edge, edge, on))
                    else:
                        both, gt, pred = int(tumour[pick].sum()), int(tumour.sum()), int(n[pick].sum())
                    found[key] = 1.0 if gt == 0 else 2.0 * both / (gt + pred + EPS)
                rows += [(k, found[key], int(kept.sum()), len(value)) for k in ids]
        return list(zip(*rows, strict=True)) or [[]] * 4  # nothing asked

    return bricks.from_bricks(voxels, [_as(voxels, value, "double"), F.coalesce(F.col("seg") == 2, F.lit(False))], run, f"config_id {kind}, dice double, supernodes bigint, voxels bigint", halo=False)
