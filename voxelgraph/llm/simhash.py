"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance r or less have a common neighbour within r / 2 of both. So every different
fingerprint emits all variants within half the radius, variants are the shuffle key, and who meets there is
linked. Copies collapse to one fingerprint before anything is emitted, and a variant can only gather as
many fingerprints as its own ball holds, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelgraph.llm.tokens import text_of
from voxelgraph.operators.components import connected_components
from voxelgraph.session import staged, table


def words_of(text: str) -> list[bytes]:
    """Words between white space (ASCII), A-Z in lower case."""
    return text.encode().lower().split()


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included; the whole text where it has fewer."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits whether it is set in over half of the hashes."""
    ones = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return 2 * ones > len(hashes)


def fingerprint(text: str, size: int) -> int:
    """64-bit SimHash over XXH64 (seed 42) of the word shingles, as a signed number; 0 without words."""
    shingles = shingles_of(words_of(text), size)
    if not shingles:
        return 0
    h = xxhash.xxh64_intdigest
    bits = majority(np.fromiter((h(x, 42) for x in shingles), "<u8", len(shingles)))
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, fp)`` for each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array((fingerprint(t.as_py(), size) for t in batch.column(1)), pa.int64(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def ball(fp: Column, bits: int, radius: int) -> Column:
    """All values within ``radius`` bits of ``fp``, as an array."""
    masks = [sum(1 << b for b in flips) for k in range(radius + 1) for flips in combinations(range(bits), k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda m: fp.bitwiseXOR(m.cast("bigint")))


def ball_links(different: DataFrame, fp: str, radius: int, bits: int = 64) -> DataFrame:
    """Links ``(src, dst)`` whose components are those of all pairs at distance ``radius`` or less.

    ``different`` holds each fingerprint once. Those that meet at a variant are all within ``radius`` of one
    another (the triangle inequality), so linking each to the least keeps every component. The distance is
    checked once more.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    met = different.select(F.col(fp).alias("src"), F.explode(ball(F.col(fp), bits, radius // 2)).alias("variant"))
    links = met.withColumn("dst", F.min("src").over(Window.partitionBy("variant"))).where("src <> dst").select("src", "dst").distinct()
    return links.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)


def components(prints: DataFrame, radius: int) -> DataFrame:
    """``(doc_id, fp, component_id)``: the least doc_id reachable over links between equal or near fingerprints.

    A null doc_id is never the least; a component of nulls only has a null id.
    """
    prints = staged(prints)
    different = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    group = connected_components(ball_links(different, "fp", radius)).select(F.col("node").alias("fp"), "component")
    grouped = different.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    names = staged(grouped.join(heads, "component").select("fp", "component_id"))
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: three-word shingles, linked at two differing bits or fewer."""
    found = components(fingerprints(table(spark, sf_dir, "documents"), 3), 2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
