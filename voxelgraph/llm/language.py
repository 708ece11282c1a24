"""Language identification by a blended-spectrum string kernel.

Two texts are as alike as the runs of one to three letters that both have (presence, not counts), over the root
of how many each has. Landmarks, some texts of every language, span the kernel's feature space (Nyström): a text
is its kernel with each landmark, times the inverse root of the landmarks' own kernel. On these features one
ridge regression for each language tells it from the rest. Kernel values of a batch of texts are one matrix
product of their presence rows with the landmarks' presence columns; the scores are a second one.

The fit takes a bounded sample: at most about ``ROWS`` training documents of each language, of which up to
``LANDMARKS`` are landmarks. Their kernel values are computed by tasks; only those and the landmarks' runs reach
the driver. Every text is read whole, in the sample and in the one pass that scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgraph.llm.tokens import text_of
from voxelgraph.session import ship, staged, table

#: Longest run of letters that counts; three code points fill one 64-bit number.
LONGEST = 3
#: Training documents and landmarks of each language, at most about; runs of a landmark, at most.
ROWS, LANDMARKS, LANDMARK_RUNS = 600, 32, 8_192
#: Ridge for each training row, and the least share of the largest eigenvalue that a landmark direction needs.
RIDGE, FLOOR = 1e-4, 1e-6
#: Texts of one matrix product.
BATCH = 256
NO_LANGUAGE = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters; made once for each worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def runs(text: str) -> np.ndarray:
    """The different runs of one to ``LONGEST`` code points of a lower-cased text, ascending.

    Whatever is not a letter is a blank, and blanks in a row are one; so is each end. A text without letters has
    no runs.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[c]
    if not is_letter.any():
        return np.empty(0, "i8")
    blank = np.concatenate([[True], ~is_letter, [True]])
    c = np.where(blank, 32, np.concatenate([[32], c, [32]])).astype("i8") + 1
    c = c[~blank | np.concatenate([[True], ~blank[:-1]])]
    found, run = [], np.zeros(len(c), "i8")
    for n in range(LONGEST):
        run = (run[: len(c) - n] << 21) | c[n:]
        found.append(run)
    ordered = np.sort(np.concatenate(found))
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


def presence(rows: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """A row for each text: 1 where it has the run of the vocabulary (ascending)."""
    out = np.zeros((len(rows), len(vocabulary)), "f4")
    for k, r in enumerate(rows):
        at = np.searchsorted(vocabulary, r)
        at[at == len(vocabulary)] = 0
        out[k, at[vocabulary[at] == r] if len(vocabulary) else []] = 1
    return out


class Landmarks:
    """Texts that span the feature space, as presence columns over the runs they have."""

    def __init__(self, rows: list[np.ndarray]):
        self.vocabulary = np.unique(np.concatenate(rows)) if rows else np.empty(0, "i8")
        self.columns, self.size = np.ascontiguousarray(presence(rows, self.vocabulary).T), np.array([max(1, len(r)) for r in rows], "f8")

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts (their runs) with every landmark; a text without runs has zeros.

        The product counts common runs, whole numbers that 32-bit floats hold, so a value doesn't depend on the
        other texts of its batch.
        """
        own = np.array([max(1, len(r)) for r in rows], "f8")
        return (presence(rows, self.vocabulary) @ self.columns).astype("f8") / np.sqrt(own[:, None] * self.size)


class Model:
    """Landmarks, the weights of their kernel values for each language, and the languages in order."""

    def __init__(self, landmarks: Landmarks, weights: np.ndarray, bias: np.ndarray, languages: list[str]):
        self.landmarks, self.weights, self.bias, self.languages = landmarks, weights, bias, languages

    def predicted(self, rows: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        """(language, score from 0 to 1) of each text; without runs, or without a language learnt, ``und`` and 0."""
        if not self.languages:
            return [NO_LANGUAGE] * len(rows), np.zeros(len(rows))
        # summed row by row and rounded: equal texts score alike wherever they stand
        values = np.round(np.einsum("ij,jk->ik", self.landmarks.kernel(rows), self.weights) + self.bias, 9)
        best = values.argmax(1)
        some = np.array([len(r) > 0 for r in rows], bool)
        score = np.where(some, np.clip((values[np.arange(len(rows)), best] + 1) / 2, 0, 1), 0.0)
        return [self.languages[b] if s else NO_LANGUAGE for b, s in zip(best, some, strict=True)], score


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _in_batches(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(first column's value, runs of the second column's text) row by row."""
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            yield key.as_py(), runs(text.as_py())


def sample(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """``(lang, text, place)``: about ``rows`` training documents of each language (all where there are fewer), in two passes.

    By a hash of id and text, so that no language's rows meet in one task; rows that repeat count once. Rows
    without an id, a language or a letter don't count.
    """
    training = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = training.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return training.select("lang", "text", F.lit(0).cast("bigint").alias("place")).limit(0)
    part = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, rows / r["count"])))))
    place = F.xxhash64("doc_id", "text")
    chosen = training.select("lang", "text", place.alias("place")).where(F.pmod(place, F.lit(1 << 30)) < part[F.col("lang")] * (1 << 30))
    # twice the expected rows of all languages together: a bound even for odd hashes
    return chosen.distinct().limit(2 * rows * len(counts))


def fitted(docs: DataFrame, rows: int = ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model of ``docs`` (``doc_id, text, lang``)."""
    ship(docs.sparkSession)
    texts = staged(sample(docs, rows))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs(t.as_py()) for t in batch.column(1)]
            fits = pa.array([0 < len(r) <= LANDMARK_RUNS for r in found])
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in found], pa.binary())], names=["lang", "place", "runs"])
            yield out.filter(fits)

    # the first landmarks of each language by their hash; what is ranked is the bounded sample
    able = texts.mapInArrow(marked, "lang string, place bigint, runs binary")
    first = able.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "runs"))), 1, landmarks).alias("first"))
    chosen = sorted(first.select("lang", F.explode("first.runs").alias("runs")).collect(), key=lambda r: (r["lang"], bytes(r["runs"])))
    spread = Landmarks([np.frombuffer(r["runs"], "i8") for r in chosen])

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_batches(_each(batches), BATCH):
            values = spread.kernel([r for _, r in part])
            some = [k for k, (_, r) in enumerate(part) if len(r)]
            yield pa.RecordBatch.from_arrays([pa.array([part[k][0] for k in some], pa.string()), pa.array([values[k].tobytes() for k in some], pa.binary())], names=["lang", "kernel"])

    measured = sorted(((r["lang"], bytes(r["kernel"])) for r in texts.select("lang", "text").mapInArrow(valued, "lang string, kernel binary").collect()))
    return regression(spread, [lang for lang, _ in measured], np.frombuffer(b"".join(k for _, k in measured), "f8").reshape(len(measured), -1) if measured else np.empty((0, 0)), ridge)


def regression(landmarks: Landmarks, langs: list[str], kernel: np.ndarray, ridge: float = RIDGE) -> Model:
    """One ridge regression for each language against the rest, on Nyström features of kernel values (a row for each text)."""
    languages = sorted(set(langs))
    if not languages or not len(landmarks.vocabulary):
        return Model(landmarks, np.empty((0, 0)), np.empty(0), [])
    own = (landmarks.columns.T @ landmarks.columns).astype("f8") / np.sqrt(landmarks.size[:, None] * landmarks.size)
    values, vectors = np.linalg.eigh(own)
    kept = values > FLOOR * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    target = np.where(np.array(langs)[:, None] == np.array(languages)[None], 1.0, -1.0)
    # languages weigh alike, however many rows each has
    counts = (target > 0).sum(0)
    weight = (target > 0) @ (len(langs) / len(languages) / counts)
    features = kernel @ root
    mean, middle = np.average(features, 0, weight), np.average(target, 0, weight)
    x = (features - mean) * weight[:, None]
    solved = np.linalg.solve(x.T @ (features - mean) + ridge * len(langs) * np.eye(features.shape[1]), x.T @ (target - middle))
    return Model(landmarks, root @ solved, middle - mean @ solved, languages)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row of ``docs`` (``doc_id, text``), repeats included.

    ``und`` with score 0 for a null text or one without a letter.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for part in _in_batches(_each([batch]), BATCH):
                lang, score = model.predicted([r for _, r in part])
                langs += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, lang_pred string, score double")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all ``documents``, by whole texts.

    One row for each row, repeated ids included, and a null id (never held out, never learnt from). A null text
    and one without letters (an empty one too) are ``und`` with score 0; a text of any length is read whole; of
    equal scores the first language by name is taken; without a row to learn from everything is ``und``; an empty
    table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, fitted(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
