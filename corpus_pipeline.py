"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept and is written as Parquet in the shared folder before the
next one reads it, so a lost executor repeats no more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgraph.llm import mixing, near_dedup, packing, pii, quality
from voxelgraph.llm.tokens import text_of
from voxelgraph.session import ship, staged, table

#: Scores from here on are kept.
KEEP_FROM = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null text is judged as an empty one, every row of an id on its own text; texts are read whole; without a
    trusted document all stay; an empty table stays empty. All columns are kept, whatever their names.
    """
    ship(spark)
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.text_score(text_of()) >= KEEP_FROM)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, likeness 0.8 or more) stays.

    It is the one with the least id; texts without words (null too) are one group; rows without an id all stay;
    of repeated rows one stays, and unlike texts under one id all do; an empty table stays empty.
    """
    return near_dedup.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; ``n_chars``, where there is one, follows the text.

    Null texts stay null and keep their ``n_chars``; equal rows stay equal; an empty table stays empty; all
    other columns are kept, whatever their names.
    """
    changed = pii.pseudonymised(docs, pii.QUERY_KEY).select(*(F.col(f"`{c}`") for c in docs.columns))
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the raked weights of source, language and topic.

    A null source or language is a value like any other; null and empty texts have no tokens and are kept with
    their cell's chance; rows of one id share their fate; an empty table stays empty. All columns are kept,
    whatever their names.
    """
    weights = mixing.probabilities(staged(mixing.measured(docs)))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", "lang", mixing.topic(text_of()).alias("topic"))
    return mixing.sampled(rows, weights).where("kept").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids.

    A null text is an empty one, which is its end mark alone; rows that repeat are packed each; texts of any
    length are cut into pieces; other columns are left out; an empty table gives no pieces.
    """
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models, fingerprints and merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
