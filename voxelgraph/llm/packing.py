"""Order-preserving packing of token streams into sequences by dynamic programming.

Each task encodes the documents it reads, in their order, and lays their ids end to end. Cuts may fall
after a document (free), after a sentence (a small penalty) or, where neither comes soon enough, inside a
sentence (a large one). The cheapest cuts minimise padding plus penalties over windows of at most
``length`` ids: f(j) = length - p(j) + penalty(j) + min over i with p(j) - p(i) <= length of f(i) + p(i), and
a monotone queue gives that minimum in constant time. Documents never move between tasks, so nothing is
shuffled; a task holds ``CHUNK`` ids at a time and pads one last sequence for each chunk (under 0.1 %).
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgraph.llm.tokens import encoder, text_of, vocabulary_path
from voxelgraph.session import table

#: Ids of a chunk, and the distance of the emergency cuts inside a sentence.
CHUNK, STRIDE = 1 << 21, 128
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cheapest_cuts(places: list[int], penalties: list[int], length: int) -> list[int]:
    """The places to cut at, the last one included; place 0 is where the stream begins.

    ``places`` ascend and no gap between neighbours, or from 0, exceeds ``length``.
    """
    best = [0] * (len(places) + 1)
    back = [0] * (len(places) + 1)
    at = [0, *places]
    queue = deque([0])
    value = [0] * (len(places) + 1)  # best + place
    for j in range(1, len(at)):
        p = at[j]
        while p - at[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        best[j] = value[i] + length - p + penalties[j - 1]
        v = value[j] = best[j] + p
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def _sentence_ends(e) -> np.ndarray:
    """For each id whether a sentence or a line can end with it."""
    tails = (b".", b"!", b"?", b"\n", "。".encode(), "！".encode(), "？".encode())
    return np.array([t is not None and t.endswith(tails) for t in (_token(e, i) for i in range(e.tokenizer.get_vocab_size()))])


def _token(e, i: int) -> bytes | None:
    try:
        return e.ranks.decode_single_token_bytes(i)
    except KeyError:
        return None


def _places(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, length: int, penalty: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Places for cuts and their penalties."""
    cost = np.full(len(ids) + 1, -1, "i4")
    cost[STRIDE : len(ids) : STRIDE] = penalty[1]
    cost[1:][sentence[ids]] = penalty[0]
    cost[ends] = 0
    places = np.flatnonzero(cost >= 0)
    places = places[places > 0]
    return places.tolist(), cost[places].tolist()


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, sentence_penalty: int = 32, word_penalty: int = 256, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents and where they lie: one row for each part of a document in one sequence.

    ``docs`` needs ``doc_id`` and ``text``; a null or empty text has only its end id. ``start``: ids of the
    document before the piece; ``offset``: ids of the sequence before it. ``sequence_id`` is unique and
    counts up within a task. ``keep_ids`` adds the piece's ids. Repeated rows are packed each on its own;
    an empty table gives no rows. ``length`` must be at least ``STRIDE``.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        sentence = _sentence_ends(e)
        next_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: list[tuple[int | None, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id
            ids = np.concatenate([x for _, x in held])
            sizes = np.array([len(x) for _, x in held])
            ends = np.cumsum(sizes)
            cuts = np.array(cheapest_cuts(*_places(ids, ends, sentence, length, (sentence_penalty, word_penalty)), length))
            stops = np.union1d(ends, cuts)
            starts = np.concatenate([[0], stops[:-1]])
            doc, seq = np.searchsorted(ends, starts, "right"), np.searchsorted(cuts, starts, "right")
            raw = memoryview(ids.tobytes())
            columns = [
                pa.array([held[d][0] for d in doc], pa.int64()),
                pa.array(starts - (ends - sizes)[doc]),
                pa.array(stops - starts),
                pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.int64()),
                pa.array(sizes[doc]),
                pa.array(seq + next_id),
                pa.array(starts - np.concatenate([[0], cuts])[seq]),
            ]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.view("<i4"), pa.int32())))
                names.append("ids")
            next_id += len(cuts)
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(e.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                held.append((doc_id.as_py(), ids))
                n += len(ids)
                if n >= CHUNK:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(run, SCHEMA + ", ids array<int>" * keep_ids)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 ids."""
    return pack(table(spark, sf_dir, "documents"))
