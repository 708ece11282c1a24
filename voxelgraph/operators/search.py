"""Parameter search: grids, scoring of configurations, sweeps.

What a contraction depends on (a merge tolerance, a window) is part of the case's key, so that all of a grid runs
in one job; what merely filters regions is joined to the table of regions.
"""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelgraph.functions import scalars
from voxelgraph.operators import contract, evaluate, features, stencil, whole
from voxelgraph.operators import edges as E
from voxelgraph.session import staged

#: The diagnosis' six configurations as (psi, alpha, beta_min, beta_max, m_min, m_max).
NAMED = {
    "current": (0.12, 0.12, 10, 500_000, 0.0, 1.0),
    "lower beta": (0.12, 0.12, 2, 500_000, 0.0, 1.0),
    "no deletion": (0.12, 0.12, 1, 500_000, 0.0, 1.0),
    "tighter psi": (0.05, 0.05, 10, 500_000, 0.0, 1.0),
    "tighter psi, lower beta": (0.05, 0.05, 2, 500_000, 0.0, 1.0),
    "tighter psi, no deletion": (0.05, 0.05, 1, 500_000, 0.0, 1.0),
}
CONFIG = "config_id int, psi double, alpha double, beta_min int, beta_max int, m_min double, m_max double"


def intensity_range(voxels: DataFrame, value: str, bins: int = 65_536) -> DataFrame:
    """One row: 1st and 99th percentile over all voxels, exact (linear between ranks).

    Values are counted in ``bins`` equal parts of their range first; only parts that hold one of the four ranks
    needed are then counted value by value, so no task holds all different values.
    """
    low, high, n = voxels.agg(F.min(value), F.max(value), F.count(value)).first()
    if not n:
        return voxels.select(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")).limit(1)
    width = (high - low) / bins or 1.0
    held = voxels.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = [p * (n - 1) for p in (0.01, 0.99)]
    ranks = sorted({int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places})
    counts = held.groupBy("bin").count().withColumn("end", F.sum("count").over(upto)).withColumn("begin", F.col("end") - F.col("count"))  # at most ``bins`` rows
    wanted = F.lit(False)
    for r in ranks:
        wanted = wanted | ((F.col("begin") <= r) & (F.col("end") > r))
    few = counts.where(wanted).select("bin", "begin")
    values = held.join(F.broadcast(few), "bin").groupBy("bin", "begin", "v").count()
    inside = Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = values.withColumn("end", F.col("begin") + F.sum("count").over(inside)).withColumn("first", F.col("end") - F.col("count"))
    at = {r: F.max(F.when((F.col("first") <= r) & (F.col("end") > r), F.col("v"))) for r in ranks}
    lower, upper = ((at[int(p)], at[min(int(p) + 1, n - 1)], p - int(p)) for p in places)
    between = lambda a, b, part: a + (b - a) * part
    return placed.agg(between(*lower).alias("low"), between(*upper).alias("high"))


def param_grid(spark: SparkSession, low: float, high: float, n_psi: int = 16, n_alpha: int = 8, n_beta: int = 8, beta_max: int = 500_000, skip: bool = False, second: bool = False) -> DataFrame:
    """Configurations in loop order. ``second``: the fixed grid; ``skip``: leave out alpha below psi."""
    r = high - low
    a, b, c, d, e, f = (0.005, 0.15, 0.01, 0.25, 0.5, 3.0) if second else (0.02 * r, 0.35 * r, 0.05 * r, 0.5 * r, 1.0, 3.5)

    def axis(n: int, name: str, lo: float, hi: float) -> DataFrame:
        step = (hi - lo) / max(n - 1, 1)
        return spark.range(n).select(F.col("id").alias(f"i_{name}"), (F.lit(lo) + F.col("id") * step).alias(name))

    # three axes of a parameter grid
    grid = axis(n_psi, "psi", a, b).crossJoin(axis(n_alpha, "alpha", c, d)).crossJoin(axis(n_beta, "e", e, f)).withColumn("beta_min", F.pow(F.lit(10.0), F.col("e")).cast("int"))
    grid = grid.where("alpha >= psi") if skip else grid
    number = (F.row_number().over(Window.orderBy("i_psi", "i_alpha", "i_e")) - 1).cast("int")
    return grid.select(number.alias("config_id"), "psi", "alpha", "beta_min", F.lit(beta_max).alias("beta_max"), F.lit(low).alias("m_min"), F.lit(high).alias("m_max"))


def random_search(spark: SparkSession, n: int, seed: int = 42, wide: bool = False) -> DataFrame:
    """n configurations at random: log-uniform psi, alpha and sizes, uniform mean bounds."""
    b = (0.005, 0.3, 0.005, 0.5, 1, 50_000, 0.3, 0.7) if wide else (0.02, 0.2, 0.02, 0.3, 1, 200, 0.15, 0.85)
    u = lambda k: F.rand(seed + k)
    log = lambda k, lo, hi: F.exp(F.log(F.lit(float(lo))) + u(k) * (F.log(F.lit(float(hi))) - F.log(F.lit(float(lo)))))
    top = F.lit(500_000) if wide else log(3, 2_000, 50_000).cast("int")
    return spark.range(0, n, 1, 1).select(F.col("id").cast("int").alias("config_id"), log(0, b[0], b[1]).alias("psi"), log(1, b[2], b[3]).alias("alpha"), log(2, b[4], b[5]).cast("int").alias("beta_min"), top.alias("beta_max"), (u(4) * b[6]).alias("m_min"), (b[7] + u(5) * (1 - b[7])).alias("m_max"))


def variants(voxels: DataFrame, options: DataFrame) -> DataFrame:
    """Every case once for each of ``options`` (``variant`` 0 to K - 1 and columns to add), as a case of its own.

    Its id is ``case_id * K + variant``, so what works case by case works on all variants in one job.
    """
    k = options.count()
    many = voxels.crossJoin(F.broadcast(options))  # options are a parameter list
    return many.withColumn("case_id", (F.col("case_id") * k + F.col("variant")).cast("bigint"))


def _apart_again(df: DataFrame, k: int) -> DataFrame:
    """Ids of ``variants`` as the ``case_id`` and ``variant`` that they come from."""
    return df.withColumn("variant", F.pmod("case_id", F.lit(k)).cast("int")).withColumn("case_id", F.expr(f"(case_id - variant) div {k}"))


def grid_search(voxels: DataFrame, value: str, configs: DataFrame, method: str = "quantized", measure: str = "boundary", stride: int = 20) -> DataFrame:
    """``(config_id, case_id, dice, supernodes, compression)`` for every configuration and case.

    One contraction for each different psi. ``quantized``: cases in one brick are contracted and scored where they are,
    all configurations in one crossing; of cases over several bricks each has a copy for each number of bins, which is
    part of its key. The other methods contract one psi after the other. There sizes and means are filtered per
    configuration on the region table. ``measure``: ``boundary`` (surface Dice) or ``volume`` (from counts).
    """
    spark = voxels.sparkSession
    asked = configs.select("config_id", "psi", "beta_min", "beta_max", "m_min", "m_max").collect()  # a parameter list
    psis = sorted({r.psi for r in asked})
    # quantised contractions differ by their bins alone, and several psi ask for as many
    ways = {key: n for n, key in enumerate(dict.fromkeys(scalars.psi_bins(psi) if method == "quantized" else psi for psi in psis))}
    k = max(1, len(ways))
    options = spark.createDataFrame([(ways[scalars.psi_bins(psi) if method == "quantized" else psi], psi, scalars.psi_bins(psi)) for psi in psis], "variant int, psi double, __bins int")
    done = None
    if method == "quantized":
        held = voxels.select("case_id", *stencil.AXES, "lin", value, "seg")
        small, wide = whole.by_extent(held)
        many = variants(held if wide is None else wide, options.select("variant", "__bins").distinct())  # made for wide cases only
        of_bins: dict[int, dict[tuple, list[int]]] = {}
        for r in asked:
            of_bins.setdefault(scalars.psi_bins(r.psi), {}).setdefault((r.beta_min, r.beta_max, r.m_min, r.m_max), []).append(r.config_id)
        done = whole.searched(small, value, of_bins, measure != "volume", dict(configs.dtypes)["config_id"])
        done = done.select("config_id", "case_id", "dice", "supernodes", (F.col("voxels") / F.greatest("supernodes", F.lit(1))).alias("compression"))
        if wide is None:
            return done
        labelled = contract.connected(many, scalars.quantize(F.col(value), F.col("__bins"))).drop("variant", "__bins")
    else:
        each = [contract.contracted(voxels, value, method, psi, psi, 500_000, scalars.psi_bins(psi), stride).withColumn("case_id", (F.col("case_id") * k + n).cast("bigint")) for n, psi in enumerate(psis)]
        labelled = reduce(DataFrame.unionByName, each, each.pop(0))
    labelled = staged(labelled)
    asked = staged(configs.join(F.broadcast(options.select("psi", "variant")), "psi"))
    of = F.pmod("case_id", F.lit(k)).cast("int")
    stats = staged(features.label_counts(labelled).join(E.region_means(labelled, value), ["case_id", "label"]))
    kept = stats.withColumn("variant", of).join(F.broadcast(asked), "variant").where(F.col("n").between(F.col("beta_min"), F.col("beta_max")) & F.col("mean").between(F.col("m_min"), F.col("m_max")))  # configurations are a parameter list
    totals = staged(stats.groupBy("case_id").agg(F.sum("n_tumour").alias("gt"), F.sum("n").alias("voxels")))
    base = totals.withColumn("variant", of).join(F.broadcast(asked.select("config_id", "variant")), "variant").drop("variant")
    regions = kept.groupBy("config_id", "case_id").agg(F.count("*").alias("supernodes"))
    if measure == "volume":
        sums = kept.where(evaluate.share(0.1)).groupBy("config_id", "case_id").agg(F.sum("n_tumour").alias("both"), F.sum("n").alias("pred"))
        scored = base.join(sums, ["config_id", "case_id"], "left").fillna(0, ["both", "pred"]).select("config_id", "case_id", evaluate.dice_of(F.col("both"), F.col("gt"), F.col("pred"), "one").alias("dice"))
    else:
        scored = _boundary(labelled, kept, base.select("config_id", "case_id"))
    out = base.join(scored, ["config_id", "case_id"]).join(regions, ["config_id", "case_id"], "left").fillna(0, ["supernodes"])
    out = _apart_again(out, k).select("config_id", "case_id", "dice", "supernodes", (F.col("voxels") / F.greatest("supernodes", F.lit(1))).alias("compression"))
    return out if done is None else done.unionByName(out)


def _boundary(labelled: DataFrame, kept: DataFrame, base: DataFrame) -> DataFrame:
    """Surface Dice of every configuration's mask; ``base``: ``config_id, case_id`` of all. Equal choices are scored once."""
    chosen = kept.where(evaluate.share(0.1) & (F.col("label") > 0)).groupBy("config_id", "case_id").agg(F.sort_array(F.collect_list(F.col("label").cast("bigint"))).alias("labels"))
    of = staged(base.join(chosen, ["config_id", "case_id"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<bigint>"))).withColumn("choice", F.xxhash64("labels")))
    different = of.groupBy("case_id", "choice", "labels").agg(F.count("*").alias("n")).drop("n")
    scored = evaluate.surface_scores(staged(evaluate.surface_signatures(labelled)), different)
    return of.select("config_id", "case_id", "choice").join(scored, ["case_id", "choice"]).select("config_id", "case_id", "dice")


def search_log(scores: DataFrame, configs: DataFrame, penalty: bool = False, per_case: bool = False) -> DataFrame:
    """Per configuration: mean score, mean regions and compression, scores by case; ``penalty`` halves scores of
    configurations (or of single cases) with under 100 or over 50,000 regions."""
    odd = lambda c: (F.col(c) < 100) | (F.col(c) > 50_000)
    s = scores.withColumn("dice", F.when(odd("supernodes"), F.col("dice") / 2).otherwise(F.col("dice"))) if penalty and per_case else scores
    # exact sums, so that configurations that choose alike tie whatever the order of their cases
    mean = (F.sum(F.col("dice").cast("decimal(17,15)")).cast("double") / F.count("dice")).alias("score")
    log = s.groupBy("config_id").agg(mean, F.avg("supernodes").alias("mean_supernodes"), F.avg("compression").alias("mean_compression"), F.sort_array(F.collect_list(F.struct("case_id", "dice"))).alias("per_case"))
    if penalty and not per_case:
        log = log.withColumn("score", F.when(odd("mean_supernodes"), F.col("score") / 2).otherwise(F.col("score")))
    return configs.join(log, "config_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def best_config(log: DataFrame) -> DataFrame:
    """The first configuration with the highest score."""
    return log.orderBy(F.desc("score"), "config_id").limit(1)


def top_configs(log: DataFrame, k: int = 5) -> DataFrame:
    return log.orderBy(F.desc("score"), "config_id").limit(k)


def config_sweep(voxels: DataFrame, value: str, named: dict[str, tuple] | None = None, method: str = "adaptive", stride: int = 20) -> DataFrame:
    """Per named configuration: mean oracle Dice, deletion loss and regions, over cases with a tumour; best first flagged.

    Configurations that differ in sizes and means alone share one contraction, and are filters of its regions.
    """
    spark, out, done = voxels.sparkSession, None, {}
    with_tumour = voxels.where("seg = 2").select("case_id").distinct()
    kept = staged(voxels.join(with_tumour, "case_id", "left_semi"))
    for k, (name, (psi, alpha, lo, hi, m0, m1)) in enumerate((named or NAMED).items()):
        if (psi, alpha) not in done:
            done[psi, alpha] = _regions(contract.contracted(kept, value, method, psi, alpha, hi, scalars.psi_bins(psi), stride), value)
        ok = F.col("n").between(lo, hi) & F.col("mean").between(m0, m1)
        counts = staged(done[psi, alpha].withColumn("label", F.when(ok, F.col("label")).otherwise(0)).groupBy("case_id", "label").agg(*(F.sum(c).alias(c) for c in ("n", "n_organ", "n_tumour"))))
        regions = counts.groupBy("case_id").agg(F.sum((F.col("label") > 0).cast("bigint")).alias("supernodes"))
        row = evaluate.oracle(_apart(done[psi, alpha], ok)).join(evaluate.deletion_loss(counts).select("case_id", "lost_pct"), "case_id").drop("supernodes").join(regions, "case_id")
        row = row.agg(F.avg("dice").alias("oracle_dice"), F.avg("lost_pct").alias("lost_pct"), F.avg("supernodes").alias("supernodes")).select(F.lit(k).alias("k"), F.lit(name).alias("config"), "oracle_dice", "lost_pct", "supernodes")
        out = row if out is None else out.unionByName(row)
    out = staged(out) if out is not None else spark.createDataFrame([], "k int, config string, oracle_dice double, lost_pct double, supernodes double")
    top = out.agg(F.max(F.struct("oracle_dice", (-F.col("k")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("b"))
    return out.crossJoin(F.broadcast(top)).select("config", "oracle_dice", "lost_pct", "supernodes", (F.col("k") == F.col("b")).alias("best"))  # one row


def _regions(labelled: DataFrame, value: str) -> DataFrame:
    """Counts and mean of each region: all that filters and scores of a configuration need."""
    labelled = staged(labelled)
    return staged(features.label_counts(labelled).join(E.region_means(labelled, value), ["case_id", "label"], "left"))


def _apart(regions: DataFrame, ok: Column) -> DataFrame:
    """Counts with deleted regions as one row of label 0 for each of them."""
    return regions.select("case_id", F.when(ok, F.col("label")).otherwise(0).alias("label"), "n", "n_organ", "n_tumour")


def beta_sweep(counts: DataFrame, betas: list[int], threshold: float = 0.1, faces: DataFrame | None = None) -> DataFrame:
    """Per least size: regions, tumour regions, oracle Dice and capture over all cases, deleted voxels in percent, edges.

    Nothing is contracted again: sizes are filtered on the table of counts.
    """
    asked = F.broadcast(counts.sparkSession.createDataFrame([(b,) for b in betas], "beta_min int"))
    j = counts.crossJoin(asked).withColumn("ok", (F.col("label") > 0) & (F.col("n") >= F.col("beta_min")))  # a parameter list
    t = F.col("ok") & evaluate.share(threshold)
    pick = lambda m, c: F.sum(F.when(m, F.col(c)).otherwise(0))
    per = j.groupBy("beta_min", "case_id").agg(F.sum(F.col("ok").cast("bigint")).alias("supernodes"), F.sum(t.cast("bigint")).alias("tumour_supernodes"), pick(t, "n_tumour").alias("both"), pick(t, "n").alias("pred"), F.sum("n_tumour").alias("gt"), pick(~F.col("ok"), "n").alias("gone"), F.sum("n").alias("voxels"))
    out = per.groupBy("beta_min").agg(
        F.sum("supernodes").alias("supernodes"), F.sum("tumour_supernodes").alias("tumour_supernodes"), F.avg(evaluate.dice_of(F.col("both"), F.col("gt"), F.col("pred"))).alias("oracle_dice"),
        (100.0 * F.sum("both") / F.greatest(F.sum("gt"), F.lit(1))).alias("capture_pct"), (100.0 * F.sum("gone") / F.sum("voxels")).alias("deleted_pct"),
    )
    if faces is None:
        return out
    sizes = counts.where("label > 0").select("case_id", "label", "n")
    ends = faces.join(sizes.toDF("case_id", "lo", "a"), ["case_id", "lo"]).join(sizes.toDF("case_id", "hi", "b"), ["case_id", "hi"]).withColumn("least", F.least("a", "b"))
    edges = ends.crossJoin(asked).where("least >= beta_min").groupBy("beta_min").agg(F.count("*").alias("edges"))  # a parameter list
    return out.join(edges, "beta_min", "left").fillna(0, ["edges"])


def window_sweep(voxels: DataFrame, windows: dict[str, tuple[float, float]], bins: int = 8, threshold: float = 0.1) -> DataFrame:
    """Mean oracle Dice per intensity window of quantised components.

    One contraction after the other, each of the voxels where they are: copies for all windows at once would have
    ids of their own, and so would all be shuffled and held on disk together.
    """
    out = []
    for window, (lo, hi) in windows.items():
        value = (F.greatest(F.least("hu", F.lit(float(hi))), F.lit(float(lo))) - float(lo)) / (float(hi) - float(lo))
        held = voxels.select("case_id", *stencil.AXES, "lin", "seg", scalars.quantize(value, bins).alias("__bin"))
        counts = staged(features.label_counts(contract.connected(held, F.col("__bin"))))
        out.append(evaluate.oracle(counts, threshold).select("case_id", "dice", F.lit(window).alias("window")))
    scores = reduce(DataFrame.unionByName, out)
    return scores.groupBy("window").agg(F.avg("dice").alias("mean_dice"), F.count("*").alias("cases")).orderBy(F.desc("mean_dice"), "window")


def _counts(voxels: DataFrame, value: str, extent: tuple[DataFrame, DataFrame | None], method: str = "adaptive", psi: float = 0.03, alpha: float = 0.2, beta_min: int = 10, beta_max: int = 500_000, m_min: float = -1e9, m_max: float = 1e9, bins: int = 8, stride: int = 20) -> DataFrame:
    """``label_counts`` of ``contract.build_minor``, which has the same options: neither voxels nor edges are written."""
    found = contract.region_counts(voxels, value, method, psi, alpha, beta_max, bins, stride, extent)
    return staged(features.deleted(found, beta_min, beta_max, m_min, m_max))


def strategy_comparison(voxels: DataFrame, value: str, methods: dict[str, dict]) -> DataFrame:
    """``(method, case_id, supernodes, capture_pct, dice, error)``; a method that fails leaves a row with its error."""
    spark, out, extent = voxels.sparkSession, None, None
    for name, options in methods.items():
        try:
            extent = extent or whole.by_extent(voxels)
            counts = _counts(voxels, value, extent, **options)
            row = counts.groupBy("case_id").agg(F.sum((F.col("label") > 0).cast("bigint")).alias("supernodes")).join(evaluate.tumour_capture(counts), "case_id").join(evaluate.volume_dice(counts), "case_id")
            row = row.select(F.lit(name).alias("method"), "case_id", F.col("supernodes").cast("bigint").alias("supernodes"), "capture_pct", "dice", F.lit(None).cast("string").alias("error"))
        except (ValueError, RuntimeError, PySparkException, Py4JError) as e:  # whatever fails on the executors too
            row = spark.createDataFrame([(name, None, None, None, None, str(e).splitlines()[0][:500])], "method string, case_id bigint, supernodes bigint, capture_pct double, dice double, error string")
        out = row if out is None else out.unionByName(row)
    return out
