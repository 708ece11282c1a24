"""Exact length histogram of a corpus in tokens.

Each document is encoded once, whole; only its length leaves the task. Documents are then counted by
length, so that everything after the first aggregate is as large as the number of different lengths. Sums
over the shorter and the longer documents turn the histogram into totals, quantiles and truncated totals
for every context limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelgraph.llm.tokens import encoder, text_of, vocabulary_path
from voxelgraph.session import staged, table

#: Lengths summed together first, so that no task reads the whole histogram.
STEP = 256


def token_lengths(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``(n_tokens)`` for each row of ``docs``; a null or empty text has 0."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            # only one text at a time is a Python string
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter((len(e.ids(t.as_py())) for t in batch.column(0)), "i8", batch.num_rows))], names=["n_tokens"])

    return docs.select(text_of(text).alias("text")).mapInArrow(run, "n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length L that occurs, which also answers for L as the context limit.

    ``n_docs`` have exactly L tokens; ``docs_within`` have at most L and ``docs_over`` more; ``tokens_within``
    and ``tokens_over`` are their tokens; ``truncated_total`` = sum(min(length, L)); ``lost_tokens`` is what
    truncation drops; ``quantile`` = docs_within / all. An empty table gives no rows.
    """
    h = staged(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("step", F.expr(f"n_tokens div {STEP}")))
    mass = F.col("n_docs") * F.col("n_tokens")
    steps = h.groupBy("step").agg(F.sum("n_docs").alias("d"), F.sum(mass).alias("t"))
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    steps = steps.select(
        "step",
        *(F.coalesce(F.sum(c).over(w), zero).alias(f"{c}_{n}") for c in "dt" for n, w in (("before", before), ("after", after))),
    )
    low = Window.partitionBy("step").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = Window.partitionBy("step").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(steps, "step").select(
        "n_tokens",
        "n_docs",
        (F.col("d_before") + F.sum("n_docs").over(low)).alias("docs_within"),
        (F.col("d_after") + F.coalesce(F.sum("n_docs").over(high), zero)).alias("docs_over"),
        (F.col("t_before") + F.sum(mass).over(low)).alias("tokens_within"),
        (F.col("t_after") + F.coalesce(F.sum(mass).over(high), zero)).alias("tokens_over"),
    )
    return out.withColumns(
        {
            "truncated_total": F.col("tokens_within") + F.col("docs_over") * F.col("n_tokens"),
            "lost_tokens": F.col("tokens_over") - F.col("docs_over") * F.col("n_tokens"),
            "quantile": F.col("docs_within") / (F.col("docs_within") + F.col("docs_over")),
        }
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``(limit, docs_within, docs_over, truncated_total, lost_tokens)`` for any context limits, from the histogram alone."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], "limit bigint")
    short, mass = F.col("n_tokens") <= F.col("limit"), F.col("n_docs") * F.col("n_tokens")
    kept = F.col("n_docs") * F.least("n_tokens", "limit")
    return (
        histogram.crossJoin(F.broadcast(asked))  # limits are a parameter list
        .groupBy("limit")
        .agg(
            F.sum(F.when(short, F.col("n_docs")).otherwise(0)).alias("docs_within"),
            F.sum(F.when(~short, F.col("n_docs")).otherwise(0)).alias("docs_over"),
            F.sum(kept).alias("truncated_total"),
            F.sum(mass - kept).alias("lost_tokens"),
        )
    )


def quantiles(histogram: DataFrame, probabilities: list[float]) -> DataFrame:
    """``(probability, n_tokens)``: the least length that at least this share of the documents doesn't exceed."""
    asked = histogram.sparkSession.createDataFrame([(float(p),) for p in probabilities], "probability double")
    return histogram.crossJoin(F.broadcast(asked)).where("quantile >= probability").groupBy("probability").agg(F.min("n_tokens").alias("n_tokens"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of all ``documents`` and its answer for every context limit that is a length."""
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))
