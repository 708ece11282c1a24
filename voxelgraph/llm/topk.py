"""Exact top-k inner-product search, exhaustive, term at a time.

Vectors are sparse rows of integer weights. Candidates and queries are dealt into blocks of bounded size
by a hash of their id; each pair of blocks is one unit of work. Inside it every query scatters its
weighted postings, term after term, into a dense array of scores over the candidate block, and a partition
selection keeps its k best. The k best of all blocks meet in one ranked window, which Spark limits to k a
task before it shuffles. Nothing is approximated, and no unit grows with the corpus: only their number
does (queries x candidates / block sizes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelgraph.session import staged, table

#: Candidates and queries in a block; a pair of blocks holds 4096 scores for one query at a time.
CANDIDATES, QUERIES = 4096, 1024


def whole_vectors(rows: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """``(vec_id, weights)``: each component x of a usable vector as floor(scale * x), x as a double.

    A null id, a null vector, or one with null or non-finite components takes no part. Vectors may differ
    in length (missing terms weigh 0), be empty (every score 0) or repeat.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("bigint")).alias("weights")
    )


def _blocks(vectors: DataFrame, size: int, prefix: str) -> tuple[DataFrame, int]:
    """One row for each block: its rows as a list of at most about ``size``, in no order."""
    n = max(1, -(-vectors.count() // size))
    dealt = vectors.withColumn(f"{prefix}_block", F.pmod(F.xxhash64("vec_id", "weights"), F.lit(n)).cast("int"))
    return dealt.groupBy(f"{prefix}_block").agg(F.collect_list(F.struct("vec_id", "weights")).alias(prefix)), n


def _unpack(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, flat weights) of the i-th block."""
    rows = column[i].values
    ids, weights = rows.field("vec_id"), rows.field("weights")
    return ids.to_numpy(zero_copy_only=False), weights.offsets.to_numpy(), weights.values.to_numpy(zero_copy_only=False)


def _postings(offsets: np.ndarray, flat: np.ndarray, order: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term (places, weights) of the rows that hold it; places None: a weight for every row."""
    starts, lengths = offsets[:-1][order], np.diff(offsets)[order]
    out = []
    for t in range(int(lengths.max(initial=0))):
        has = np.flatnonzero(lengths > t)
        w = flat[starts[has] + t]
        if 2 * np.count_nonzero(w) > len(order):
            dense = np.zeros(len(order), "i8")
            dense[has] = w
            out.append((None, dense))
        else:
            out.append((has[w != 0], w[w != 0]))
    return out


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ids ascend."""
    at, end = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    n = len(ids) - (end - at)
    if n <= 0:
        return np.empty(0, "i8")
    if end > at:
        scores[at:end] = np.iinfo("i8").min
    if n > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.flatnonzero(scores > np.iinfo("i8").min)
    return places[np.argsort(-scores[places], kind="stable")][:k]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, offsets, flat = _unpack(batch.column("candidate"), i)
                order = np.argsort(ids, kind="stable")
                ids, postings = ids[order], _postings(offsets, flat, order)
                q_ids, q_offsets, q_flat = _unpack(batch.column("query"), i)
                found: list[list[np.ndarray]] = [[], [], []]
                scores, part = np.empty(len(ids), "i8"), np.empty(len(ids), "i8")
                for q, a, b in zip(q_ids, q_offsets[:-1], q_offsets[1:], strict=True):
                    scores[:] = 0
                    for (places, w), x in zip(postings, q_flat[a:b], strict=False):
                        if x and places is None:
                            np.multiply(w, x, out=part)
                            scores += part
                        elif x:
                            scores[places] += w * x
                    best = _best(scores, ids, q, k)
                    for into, what in zip(found, (np.full(len(best), q), ids[best], scores[best]), strict=True):
                        into.append(what)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, "i8"), pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best candidates, all if there are fewer.

    ``vectors`` and ``queries`` hold ``(vec_id, weights)`` as ``whole_vectors`` makes them. Candidates that
    have the query's own id are left out. Repeated query rows count once; repeated candidate rows each
    take a rank. Weights and sums must fit 64-bit integers.
    """
    vectors, queries = staged(vectors), staged(queries.distinct())
    candidates, _ = _blocks(vectors, CANDIDATES, "candidate")
    asked, n = _blocks(queries, QUERIES, "query")
    pairs = candidates.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(asked, "query_block")
    units = pairs.repartition("candidate_block", "query_block").select("candidate", "query")
    found = units.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def divisible(id_col: Column, by: int) -> Column:
    return id_col % by == 0


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``embeddings`` rows for every row whose ``vec_id`` is divisible by 20."""
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64.0)
    return top_k(vectors, vectors.where(divisible(F.col("vec_id"), 20)), 20)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
t AS (SELECT vec_id, unnest(range(len(w))) AS term, unnest(w) AS weight FROM v),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.weight * c.weight) AS BIGINT) AS score
  FROM t q JOIN t c ON q.term = c.term AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 20
"""
