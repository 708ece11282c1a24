"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into short paragraphs (lines, cut further after sentence marks and every 200 characters), and
the set of their digests goes into a table of cells, each a count, an exclusive-or of digests and one of check
sums. Subtracting two tables leaves the paragraphs that only one text has; peeling reads them out of cells
that hold a single one. If peeling gets stuck, both sides are laid out again in a table four times as large.
With the sizes of the sets, the number of differing paragraphs gives their Jaccard likeness exactly.

Rows are handled a batch at a time: the tables of all pairs of a batch are one array.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelgraph.llm.tokens import text_of
from voxelgraph.session import staged, table

#: Cells of the smallest table (three parts), and by how much the next one is larger.
CELLS, GROWTH = 24, 4
PARAGRAPH = re.compile(r"[^\n.!?]{1,200}[.!?]*|[.!?]{1,200}")
#: Rows of a batch whose tables are peeled together, documents meant for one bucket of neighbours, and ranges of
#: ids of about equally many documents (quantiles) that buckets are parts of.
ROWS, BUCKET, RANGES = 256, 4096, 1024
#: Buckets whose list is broadcast, at most (24 bytes each).
BROADCAST = 1_000_000
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digests(text: str) -> np.ndarray:
    """The different 64-bit digests of a text's paragraphs."""
    found = set(PARAGRAPH.findall(text))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(p) for p in found), "<u8", len(found))


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """Keys scrambled anew for each salt."""
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _check(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys, 7).astype("<u4")


def _at(keys: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    """Three cells for each key (a column each), among the ``cells`` of its owner's table."""
    part = cells // 3
    return np.stack([owner * cells + k * part + (_mixed(keys, 1000 * cells + k) % np.uint64(part)).astype("i8") for k in range(3)])


class Tables:
    """Sketches of several sets, ``cells`` for each."""

    def __init__(self, n: int, cells: int):
        self.cells = cells
        self.count = np.zeros(n * cells, "i8")
        self.key = np.zeros(n * cells, "<u8")
        self.check = np.zeros(n * cells, "<u4")

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: int | np.ndarray) -> None:
        check = _check(keys)
        for at in _at(keys, owner, self.cells):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """(differing keys read out for each set, whether all of them were)."""
        n = len(self.count) // self.cells
        read = np.zeros(n, "i8")
        look = np.arange(len(self.count))
        for _ in range(200):
            one = look[np.abs(self.count[look]) == 1]
            one = one[self.check[one] == _check(self.key[one])]
            if not len(one):
                break
            owner, keys = one // self.cells, self.key[one]
            # a key that stands alone in two cells is read once
            _, first = np.unique(np.stack([owner.astype("<u8"), keys]), axis=1, return_index=True)
            owner, keys, sign = owner[first], keys[first], self.count[one[first]]
            read += np.bincount(owner, minlength=n)
            self.add(keys, owner, -sign)
            look = np.unique(_at(keys, owner, self.cells))
        left = (self.count != 0) | (self.key != 0)
        return read, ~left.reshape(n, self.cells).any(1)

    def written(self) -> list[str]:
        """Each table as text: counts, keys, checks."""
        n = len(self.count) // self.cells
        parts = [self.count.astype("<u4"), self.key, self.check]  # a text has fewer than 2^32 paragraphs
        rows = [np.ascontiguousarray(x.reshape(n, self.cells)) for x in parts]
        return [base64.b64encode(b"".join(x[i].tobytes() for x in rows)).decode() for i in range(n)]


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(s) for s in sets]
    return (np.concatenate(sets) if sets else np.empty(0, "<u8")), np.repeat(np.arange(len(sets)), sizes)


def sketches(sets: list[np.ndarray], cells: int = CELLS) -> Tables:
    t = Tables(len(sets), cells)
    t.add(*_flat(sets), 1)
    return t


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> list[float]:
    """Jaccard likeness of each pair of digest sets, from subtracted sketches; two empty sets are equal."""
    out = [0.0] * len(left)
    todo, cells = list(range(len(left))), CELLS
    while todo:
        t = sketches([left[i] for i in todo], cells)
        keys, owner = _flat([right[i] for i in todo])
        t.add(keys, owner, -1)
        read, done = t.peel()
        for i, d, ok in zip(todo, read.tolist(), done.tolist(), strict=True):
            if ok:
                both = len(left[i]) + len(right[i])
                out[i] = (both - d) / (both + d) if both else 1.0
        todo = [i for i, ok in zip(todo, done.tolist(), strict=True) if not ok]
        cells *= GROWTH
    return out


def edited(text: str, following: str) -> str:
    """The last third of a text's characters replaced by the first as many of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut] if cut else text


def _rows(held: list[tuple[int | None, str, np.ndarray]], after: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    own, following = [d for _, _, d in held], [d for _, d in after]
    texts = [edited(t, nxt) for (_, t, _), (nxt, _) in zip(held, after, strict=True)]
    changed = [digests(t) for t in texts]
    columns = [
        pa.array([i for i, _, _ in held], pa.int64()),
        pa.array([len(t) for _, t, _ in held], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
        pa.array(sketches(own).written()),
        pa.array(sketches(changed).written()),
        pa.array(likeness(own, changed)),
        pa.array(likeness(own, following)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come bucket after bucket, each in order and ended by a copy of the row that follows it."""
    previous: tuple[int, int | None, str, np.ndarray] | None = None
    held: list = []
    after: list = []
    for batch in batches:
        for bucket, ends, doc_id, text in zip(*(batch.column(c) for c in ("bucket", "ends", "doc_id", "text")), strict=True):
            t = text.as_py()
            d = digests(t)
            if previous is not None and previous[0] == bucket.as_py():
                held.append(previous[1:])
                after.append((t, d))
                if len(held) == ROWS:
                    yield _rows(held, after)
                    held, after = [], []
            previous = None if ends.as_py() else (bucket.as_py(), doc_id.as_py(), t, d)
    if held:
        yield _rows(held, after)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see the columns of ``SCHEMA``.

    The next document is that with the next smaller ``doc_id``; after the smallest comes the largest (of one
    document: itself). Null ids come after all others; rows with one id follow each other by their texts. A
    null text is an empty one: no paragraphs, and a likeness of 1 to another empty text. An empty table gives
    no rows.

    Documents meet their next one in a bucket of neighbouring ids; the first row of each bucket is copied to
    the end of the bucket before. So texts are shuffled once, and a bucket is streamed, never held. Buckets are
    parts of ranges between quantiles of the ids, so ids far from all others don't make them uneven; rows of
    one id, or of none, are one bucket. Ids are whole numbers of up to 64 bits.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    place = (-F.col("doc_id").cast("double")).alias("place")  # never falls along the order; only buckets depend on it
    low, high, n = rows.select(place).agg(F.min("place"), F.max("place"), F.count("*")).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    ranges = max(1, min(RANGES, n // BUCKET))
    cuts = rows.select(place).approxQuantile("place", [k / ranges for k in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    cuts = sorted({float(c) for c in cuts if low < c <= high})
    edges, parts = [low, *cuts, high], max(1, -(-n // (BUCKET * ranges)))
    starts, widths = (F.array(*map(F.lit, x)) for x in (edges[:-1], [max(b - a, 1.0) for a, b in zip(edges, edges[1:])]))
    which = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="place", outputCol="range", handleInvalid="keep").transform(rows.select("*", place)) if cuts else rows.select("*", place, F.lit(0.0).alias("range"))
    at = F.col("range").cast("int")
    part = F.least(F.floor((F.col("place") - F.get(starts, at)) / F.get(widths, at) * parts), F.lit(parts - 1)).cast("bigint")
    bucket = F.when(F.col("doc_id").isNotNull(), at * parts + part).otherwise(len(edges) * parts).cast("bigint")
    placed = which.select("doc_id", "text", bucket.alias("bucket"))
    firsts = placed.groupBy("bucket").agg(F.max("doc_id").alias("first_id"))
    # one number for each bucket of thousands of documents; a corpus of too many buckets takes the other join
    buckets = staged(
        firsts.select(F.col("bucket").alias("b"), "first_id", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("goes"))
    )
    small = F.broadcast(buckets) if n <= BUCKET * BROADCAST else buckets
    heads = placed.join(small, (placed["bucket"] == small["b"]) & placed["doc_id"].eqNullSafe(small["first_id"])).groupBy("goes").agg(F.min("text").alias("text"))
    copies = heads.select(F.col("goes").alias("bucket"), F.lit(True).alias("ends"), F.lit(None).cast("bigint").alias("doc_id"), "text")
    both = placed.select("bucket", F.lit(False).alias("ends"), "doc_id", "text").unionByName(copies)
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", "ends", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(_neighbours, SCHEMA)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, whole texts."""
    return fingerprinted(table(spark, sf_dir, "documents"))
