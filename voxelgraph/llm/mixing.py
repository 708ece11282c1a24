"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in tokens by cell (source x language x topic). The cells' weights are then raked: one
marginal after the other is scaled to its targets, sweep after sweep, never past what a cell holds. A
document is kept when a hash of its id falls below its cell's weight / tokens, so that the kept tokens match
the targets in expectation and a rerun keeps the same documents.

The corpus is read twice (count, sample) and only its cells are ever grouped, with map-side sums, so a
source that holds a third of all rows costs no more than another. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelgraph.llm.tokens import text_of
from voxelgraph.session import staged, table

DIMENSIONS = ("source", "lang", "topic")
#: Targets are tempered: a value's share of the tokens to this power, so that large ones give way.
TEMPER = 0.7
#: Share of all tokens that the sample keeps, sweeps of raking, and the seed of the sample.
KEEP, SWEEPS, SEED = 0.8, 8, "mix"
#: Weights are rounded to this many decimals after each step, so that every engine computes the same ones.
DIGITS = 6
#: Cells that a window may sum in a task.
CELLS = 1_000_000


def topic(text: Column) -> Column:
    """A coarse topic by what a text is made of, whole text: table, loud, coded or prose."""
    size = F.greatest(F.length(text), F.lit(1))
    tables = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    loud = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    coded = F.length(text) - F.length(F.translate(text, "#$%&*={}<>_", ""))
    return F.when(tables * 50 > size, "table").when(loud * 50 > size, "loud").when(coded * 50 > size, "coded").otherwise("prose")


def tokens(text: Column) -> Column:
    """Tokens of a text, counted as UTF-8 bytes / 4, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("bigint")


def cells_of(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Tokens and documents of each cell."""
    return rows.groupBy(*dimensions).agg(F.sum("tokens").alias("held"), F.count("*").alias("docs"))


def marginal_targets(cells: DataFrame, dimension: str, budget: Column, temper: float) -> DataFrame:
    """``(dimension, target)``: the budget shared by (tokens of the value) ^ temper."""
    by = cells.groupBy(dimension).agg(F.sum("held").alias("h")).select(dimension, F.round(F.pow("h", F.lit(temper)), DIGITS).alias("p"))
    return by.crossJoin(F.broadcast(by.agg(F.sum(F.col("p").cast("decimal(38,6)")).cast("double").alias("all"))).join(F.broadcast(cells.agg(F.sum("held").alias("n"))))).select(
        dimension, F.round(F.lit(budget) * F.col("n") * F.col("p") / F.col("all"), DIGITS).alias("target")
    )


def _factor_by_join(out: DataFrame, dimension: str) -> DataFrame:
    """Add ``f``, target / sum of weights of the cell's value, by an aggregate joined back."""
    total = out.groupBy(F.col(dimension).alias("d")).agg(F.sum(F.col("weight").cast("decimal(38,6)")).cast("double").alias("total"))
    return out.join(total, out[dimension].eqNullSafe(total["d"])).withColumn("f", F.col(f"t_{dimension}") / F.col("total")).drop("d", "total")


def _factor_by_window(out: DataFrame, dimension: str) -> DataFrame:
    """The same by a window, for a table of checked size."""
    total = F.sum(F.col("weight").cast("decimal(38,6)")).over(Window.partitionBy(dimension)).cast("double")
    return out.withColumn("f", F.col(f"t_{dimension}") / total)


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """Add ``weight``: the cells' tokens raked to the marginal targets, at most ``held``.

    cells: a key of ``targets``' dimensions, and ``held``. Sums are taken over decimals, so their order
    doesn't matter. Up to ``CELLS`` cells (counted) the sums of a step are one window, which is the least
    work; beyond, they are aggregated on the map side and joined back.
    """
    names = cells.columns
    out = cells.withColumn("weight", F.col("held").cast("double"))
    for dimension, target in targets.items():
        t = target.select(F.col(dimension).alias("d"), F.col("target").alias(f"t_{dimension}"))
        out = out.join(t, out[dimension].eqNullSafe(t["d"])).drop("d")
    out = staged(out)
    step = _factor_by_window if out.count() <= CELLS else _factor_by_join
    for _ in range(sweeps):
        for dimension in targets:
            out = step(out, dimension).withColumn("weight", F.least(F.round(F.col("weight") * F.col("f"), DIGITS), F.col("held").cast("double"))).drop("f")
        out = staged(out)
    return out.select(*names, "weight")


def chance(key: Column, seed: str) -> Column:
    """A number from 0 to 1 for each key, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def probabilities(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, keep: float = KEEP, temper: float = TEMPER, sweeps: int = SWEEPS, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Each cell with tokens, as ``c_<dimension>``, and its ``probability``."""
    cells = staged(cells_of(rows, dimensions).where("held > 0"))
    targets = targets or {d: staged(marginal_targets(cells, d, keep, temper)) for d in dimensions}
    return staged(rake(cells, targets, sweeps).select(*(F.col(d).alias(f"c_{d}") for d in dimensions), F.round(F.col("weight") / F.col("held"), DIGITS).alias("probability")))


def sampled(rows: DataFrame, weights: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, seed: str = SEED) -> DataFrame:
    """Add ``probability`` and ``kept`` to rows with ``doc_id`` and the dimensions.

    Columns of these two names are replaced, all others are kept under any names.
    """
    names = [c for c in rows.columns if c not in ("probability", "kept")]
    held = rows.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    same = [F.col(f"row.{d}").eqNullSafe(F.col(f"c_{d}")) for d in dimensions]
    known = held.join(weights, same, "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return known.select("row.*", "probability", (chance(F.col("row.doc_id"), seed) < F.col("probability")).alias("kept"))


def calibrated(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, keep: float = KEEP, temper: float = TEMPER, sweeps: int = SWEEPS, seed: str = SEED, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add ``probability`` and ``kept`` to ``rows`` (``doc_id``, the dimensions and ``tokens``).

    targets: by dimension a table ``(dimension, target)`` in tokens; default: tempered shares of ``keep``
    of all tokens. A null value is a value like any other; a cell without tokens (or without a target)
    has probability 1; an empty table stays empty. Repeated rows share their fate.
    """
    rows = staged(rows)
    return sampled(rows, probabilities(rows, dimensions, keep, temper, sweeps, targets), dimensions, seed)


def achieved(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``(dimension, value, target, weight, off)``: how far each marginal of raked ``cells`` is from its target.

    ``off`` is the distance as a share of the target. It stays above 0 where a value holds fewer tokens than it
    should have, since weights are never above what a cell holds; otherwise more sweeps bring it down.
    """
    out = None
    for d, target in targets.items():
        t = target.select(F.col(d).alias("t"), "target")
        sums = cells.groupBy(F.col(d).alias("s")).agg(F.sum("weight").alias("weight"))
        part = t.join(sums, F.col("t").eqNullSafe(F.col("s"))).select(F.lit(d).alias("dimension"), F.col("t").cast("string").alias("value"), "target", "weight", (F.abs(F.col("weight") - F.col("target")) / F.col("target")).alias("off"))
        out = part if out is None else out.unionByName(part)
    return out


def measured(docs: DataFrame, count: Column | None = None) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens)`` of documents; a null text is an empty one.

    count: each document's tokens, where a column has exact ones; default: an estimate from its bytes.
    """
    return docs.select("doc_id", "source", "lang", topic(text_of()).alias("topic"), (tokens(text_of()) if count is None else count.cast("bigint")).alias("tokens"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with the probability that the raked cells give them, and the sample."""
    return calibrated(measured(table(spark, sf_dir, "documents")))


def _sql() -> str:
    keys = ", ".join(DIMENSIONS)
    count = "length(t) - length(replace(t, '{}', ''))"
    steps, last = [], "w0"
    for n in range(SWEEPS * len(DIMENSIONS)):
        d = DIMENSIONS[n % len(DIMENSIONS)]
        steps.append(
            f"w{n + 1} AS MATERIALIZED (SELECT {', '.join('w.' + k for k in DIMENSIONS)}, w.held, least(round(w.weight * (g.target / s.total), {DIGITS}), CAST(w.held AS DOUBLE)) AS weight "
            f"FROM {last} w JOIN (SELECT {d}, CAST(sum(CAST(weight AS DECIMAL(38,6))) AS DOUBLE) AS total FROM {last} GROUP BY {d}) s ON w.{d} IS NOT DISTINCT FROM s.{d} "
            f"JOIN t_{d} g ON w.{d} IS NOT DISTINCT FROM g.{d})"
        )
        last = f"w{n + 1}"
    targets = ",\n".join(
        f"p_{d} AS (SELECT {d}, round(pow(sum(held), {TEMPER}), {DIGITS}) AS p FROM w0 GROUP BY {d}),\n"
        f"t_{d} AS MATERIALIZED (SELECT {d}, round({KEEP} * (SELECT sum(held) FROM w0) * p / (SELECT CAST(sum(CAST(p AS DECIMAL(38,6))) AS DOUBLE) FROM p_{d}), {DIGITS}) AS target FROM p_{d})"
        for d in DIMENSIONS
    )
    return f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, source, lang,
    CASE WHEN ({count.format('|')}) * 50 > greatest(length(t), 1) THEN 'table'
         WHEN ({count.format('!')}) * 50 > greatest(length(t), 1) THEN 'loud'
         WHEN (length(t) - length(translate(t, '#$%&*={{}}<>_', ''))) * 50 > greatest(length(t), 1) THEN 'coded'
         ELSE 'prose' END AS topic,
    CAST((octet_length(encode(t)) + 3) // 4 AS BIGINT) AS tokens
  FROM d),
c AS (SELECT {keys}, CAST(sum(tokens) AS BIGINT) AS held FROM m GROUP BY {keys}),
w0 AS MATERIALIZED (SELECT {keys}, held, CAST(held AS DOUBLE) AS weight FROM c WHERE held > 0),
{targets},
{(',' + chr(10)).join(steps)},
p AS (SELECT {keys}, round(weight / held, {DIGITS}) AS probability FROM {last})
SELECT m.doc_id, m.source, m.lang, m.topic, m.tokens, coalesce(p.probability, 1.0) AS probability,
  CAST('0x' || substr(md5(coalesce(CAST(m.doc_id AS VARCHAR), '') || '{SEED}'), 1, 8) AS BIGINT) / 4294967296.0 :: DOUBLE < coalesce(p.probability, 1.0) AS kept
FROM m LEFT JOIN p ON {' AND '.join(f'm.{k} IS NOT DISTINCT FROM p.{k}' for k in DIMENSIONS)}
"""


OP9_SQL = _sql()
