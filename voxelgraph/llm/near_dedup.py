"""Near-duplicate texts: SimHash ball hashing over classes of texts, and an exact finish.

Two texts are linked when the Jaccard likeness of their word shingles reaches a threshold; classes are the
components of these links. At a likeness of 0.8 two 64-bit shingle fingerprints differ in about ten bits, a
ball too large to emit. So a text has a SimHash over its different words in several parts of 32 bits, and
each part is ball-hashed: equal parts collapse to one representative first, then each different part emits
all variants within half the radius and is paired with the least part it meets. That is at most two pairs for
a text and part, however large a crowd is, and no group is larger than a ball.

Balls miss texts that differ in a whole block, and pairs of a crowd are far more than its links. Both are the
finish's work. Of the shingles in one order for all texts, two texts as alike as the threshold share one of
the first few (a prefix filter). A shingle there that one class alone has links nothing more; where several
classes meet, rounds pair one text of each class with one of the class that most texts are in, and what is
alike merges; after the first round only classes that the last one made meet others. When a round adds little, the pairs still left between different classes that can reach the
threshold (their sizes, and what is left behind the shingle, suffice) are all compared. Members of one class
never meet again, so what is enumerated is close to what is unlike and can't be told by sizes.

Every pair is decided on the sets of shingles of the whole texts. Hashes of shingles have 64 bits in the
prefix filter and 32 bits in the comparison (two unlike shingles of one pair agree by chance once in some
millions of pairs of texts of a thousand words).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelgraph.llm.simhash import ball_links, majority, words_of
from voxelgraph.llm.tokens import text_of
from voxelgraph.operators.components import connected_components
from voxelgraph.session import ship, staged

#: Parts of a text's SimHash, their bits, and the distance at which parts meet.
PARTS, PART_BITS, RADIUS = 3, 32, 2
#: One text in so many tells which shingles are common: those that ``COMMON`` of these and one in ``SHARE`` have.
#: So there are at most ``SHARE`` times as many as a text has on average, 16 bytes each, however many texts there are.
EVERY, COMMON, SHARE = 8, 3, 8_000
#: Bits of a parity bitmap (a power of two).
PARITY = 2048
#: Rounds of pairing classes, at most, before all pairs that are left are enumerated. A round is the last if it links fewer
#: than one in ``PAYS`` of its pairs: what is left is as unlike, and each round costs the driver some 20 queries.
ROUNDS, PAYS = 6, 10

_STEP, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def word_hashes(words: list[bytes]) -> dict[bytes, int]:
    """A 64-bit hash of each different word."""
    h = xxhash.xxh64_intdigest
    return {w: h(w) for w in set(words)}


def shingle_hashes(words: list[bytes], hashes: dict[bytes, int], size: int) -> np.ndarray:
    """64-bit hashes of the different runs of ``size`` words, ascending; of the whole text where it has fewer."""
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], "<u8")
    each = np.fromiter(map(hashes.__getitem__, words), "<u8", len(words))
    m = len(words) - size + 1
    run = np.zeros(m, "<u8")
    for j in range(size):
        run = (run + each[j : j + m]) * _STEP
        run ^= run >> _SHIFT
    return np.unique(run)


def _parts(hashes: dict[bytes, int]) -> list[int]:
    """Parts of the SimHash over the different words."""
    if not hashes:
        return [0] * PARTS
    one = np.fromiter(hashes.values(), "<u8", len(hashes))
    bits = np.concatenate([majority(one ^ (one >> np.uint64(7 + k)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)) for k in range(-(-PARTS * PART_BITS // 64))])
    return np.packbits(bits, bitorder="little").view("<u4")[:PARTS].astype("i8").tolist()


def _parity(hashes: np.ndarray) -> np.ndarray:
    """Bitmap that says of each residue of the hashes whether an odd number has it, as 64-bit numbers."""
    odd = np.bincount(hashes & np.uint32(PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("<i8")


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, ascending, and the power of two of how many of the sampled texts have each.

    Any order of the shingles keeps the prefix filter exact; this one puts those that would meet many texts last.
    Sample and share are the same for any number of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                words = words_of(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(words, word_hashes(words), size).view("<i8"))], names=["token"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(EVERY)) == 0).select(text_of().alias("text"))
    least = max(COMMON, some.count() // SHARE)
    counts = some.mapInArrow(run, "token bigint").groupBy("token").count().where(F.col("count") >= least)
    found = staged(counts).toArrow()  # bounded by the share
    token, n = (found.column(c).to_numpy() for c in ("token", "count"))
    order = np.argsort(token)
    return token[order], np.frexp(n[order])[1].astype("i8")


def profiles(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """One row for each row of ``docs``, which has ``doc_id`` and ``text``.

    ``k`` numbers the rows, ``t1, t2`` hash the text as it is and ``s1, s2`` its words; ``n, shingles, parity``
    are the different shingles, ``parts`` the SimHash, ``prefix`` the first shingles in the common order, as
    many as a text as alike as the threshold can't all lack, of which the first ``rare`` aren't common ones.
    """
    known, power = _common(docs, size)

    def profile(text: str) -> tuple:
        words = words_of(text)
        hashes = word_hashes(words)
        tokens = shingle_hashes(words, hashes, size)
        short = np.unique(tokens.astype("<u4"))
        order, often = tokens.view("<i8"), np.zeros(len(tokens), "i8")
        if len(known) and len(order):
            at = np.minimum(np.searchsorted(known, order), len(known) - 1)
            often = np.where(known[at] == order, power[at], 0)
            order = order[np.argsort(often, kind="stable")]
        n = len(tokens)
        prefix = order[: n - math.ceil(threshold * n - 1e-6) + 1]
        both = xxhash.xxh3_128_intdigest(b" ".join(words))
        signed = [x - (1 << 64) if x >> 63 else x for x in (both >> 64, both & (1 << 64) - 1)]
        return (*signed, n, _parts(hashes), _parity(short), short.view("<i4"), prefix, min(len(prefix), int((often == 0).sum())))

    types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32())
    names = ("s1", "s2", "n", "parts", "parity", "shingles", "prefix", "rare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(profile(t.as_py()) for t in batch.column("text")), strict=True)) or [()] * len(types)
            columns = [pa.array(c, t) for c, t in zip(found, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "doc_id", "t1", "t2")), *columns], names=["k", "doc_id", "t1", "t2", *names])

    rows = docs.select(F.monotonically_increasing_id().alias("k"), "doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), text_of().alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"k bigint, doc_id {id_type}, t1 bigint, t2 bigint, s1 bigint, s2 bigint, n int, parts array<bigint>, parity array<bigint>, shingles array<int>, prefix array<bigint>, rare int")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def ball_pairs(texts: DataFrame) -> DataFrame:
    """Pairs ``(src, dst)`` of texts (``k, parts``) whose parts meet: at most two for a text and part.

    Texts of an equal part are paired with one of them; that one is paired with the one of the least part
    that its own part meets at a variant.
    """
    part = texts.select("k", F.posexplode("parts").alias("part", "p")).select("k", (F.col("part").cast("bigint") * (1 << PART_BITS) + F.col("p")).alias("fp"))
    reps = staged(part.groupBy("fp").agg(F.min_by("k", F.xxhash64("k", "fp")).alias("rep")))
    equal = part.join(reps, "fp").where("k <> rep").select(*_ordered("k", "rep"))
    met = ball_links(reps, "fp", RADIUS, PART_BITS).groupBy("src").agg(F.min("dst").alias("dst"))
    near = met.join(reps.toDF("src", "a"), "src").join(reps.toDF("dst", "b"), "dst").where("a <> b").select(*_ordered("a", "b"))
    return equal.unionByName(near).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """The texts ``(k)`` of ``pairs``, each once."""
    return pairs.select(F.col("src").alias("k")).unionByName(pairs.select(F.col("dst").alias("k"))).distinct()


def alike(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (``src, dst``) whose shingle sets have a Jaccard likeness of ``threshold`` or more."""
    # at least as many shingles differ as parity bits do: only what can still reach the threshold is compared whole
    some = staged(_ends(pairs))
    small = texts.select("k", "n", "parity").join(some, "k", "left_semi")
    a, b = small.toDF("src", "na", "a"), small.toDF("dst", "nb", "b")
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = staged(pairs.join(a, "src").join(b, "dst").where(apart * F.lit(1 + threshold) <= F.lit(1 - threshold) * (F.col("na") + F.col("nb")) + 1e-6).select("src", "dst"))
    ends = staged(_ends(close))
    whole = texts.select("k", "shingles").join(ends, "k", "left_semi")
    a, b = whole.toDF("src", "a"), whole.toDF("dst", "b")
    shared = F.size(F.array_intersect("a", "b"))
    return close.join(a, "src").join(b, "dst").where(shared >= F.lit(threshold) * (F.size("a") + F.size("b") - shared) - 1e-9).select("src", "dst")


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (with ``k``) and ``c``, the class of ``k``; a text that no link has is its own."""
    return rows.join(classes, "k", "left").withColumn("c", F.coalesce("c", "k"))


def _classes(links: DataFrame) -> DataFrame:
    """``(k, c)`` for the texts that ``links`` have."""
    return staged(connected_components(links).select(F.col("node").alias("k"), F.col("component").alias("c")))


def _joined(classes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``classes`` after the links ``new`` between texts, and ``(c)``, those of them that these links made.

    Only the classes that ``new`` joins are components again; texts look theirs up.
    """
    ends = new.select(F.col("src").alias("k"), "dst")
    between = _with_class(_with_class(ends, classes).select(F.col("dst").alias("k"), F.col("c").alias("src")), classes).select("src", F.col("c").alias("dst"))
    heads = staged(connected_components(staged(between.distinct())))
    known = classes.select("k").unionByName(_ends(new)).distinct()
    after = _with_class(known, classes).join(heads, F.col("c") == F.col("node"), "left").select("k", F.coalesce("component", "c").alias("c"))
    return staged(after), staged(heads.select(F.col("component").alias("c")).distinct())


def shared_prefixes(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``(token, k, n, at)`` of the prefix shingles that texts of several classes have.

    Shingles that aren't common are shuffled once. Common ones, which a large part of all texts may have, are
    counted by class before any shuffle, and what is found (bounded as ``SHARE`` says) is broadcast.
    """
    listed = _with_class(texts.select("k", "n", "prefix", "rare"), classes).select("k", "c", "n", "rare", F.posexplode("prefix").alias("at", "token"))
    slim = listed.select("token", "k", "c", F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("at")).alias("n_at"), (F.col("at") < F.col("rare")).alias("is_rare"))
    alone = Window.partitionBy("token")
    few = slim.where("is_rare").select("token", "k", "c", "n_at").select("*", F.min("c").over(alone).alias("a"), F.max("c").over(alone).alias("b")).where("a < b")
    several = slim.where("not is_rare").groupBy("token").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("token")
    many = slim.where("not is_rare").join(F.broadcast(staged(several)), "token")
    both = few.select("token", "k", "n_at").unionByName(many.select("token", "k", "n_at"))
    return both.select("token", "k", F.shiftright("n_at", 32).cast("int").alias("n"), F.col("n_at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"))


def class_pairs(held: DataFrame, threshold: float, turn: int, made: DataFrame | None = None) -> DataFrame:
    """Pairs of one text of each class at a shingle with one of the class that most texts there are in.

    held: ``(token, k, n, at, c)``. Only texts of about the same size meet. The texts differ from shingle to
    shingle and from turn to turn. made: the classes ``(c)`` that the last turn's links made; a pair has one of them, since
    classes that stayed as they were have met.
    """
    some = staged(held.withColumn("size", F.floor(F.log("n") / F.lit(-math.log(threshold)))).groupBy("token", "size", "c").agg(F.count("*").alias("m"), F.min_by("k", F.xxhash64("k", "token", F.lit(turn))).alias("k")))
    if made is None:
        some = some.withColumn("is_new", F.lit(True))
    else:
        some = staged(some.join(made.withColumn("is_new", F.lit(True)), "c", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False))))
    main = some.groupBy("token", "size").agg(F.max(F.struct("m", "c", "k", "is_new")).alias("top"), F.count("*").alias("classes"), F.max("is_new").alias("any_new")).where("classes > 1 and any_new")
    met = some.join(main, ["token", "size"]).where("c <> top.c and (is_new or top.is_new)")
    return met.select("k", F.col("top.k").alias("other")).select(*_ordered("k", "other")).distinct()


def prefix_pairs(held: DataFrame, threshold: float) -> DataFrame:
    """All pairs of different classes that can reach the threshold: an exact prefix filter.

    held: ``(token, k, n, at, c)``, ``at`` the shingle's place in the common order of its text. Of two texts as
    alike as the threshold, the smaller one's first 1 - 2t / (1 + t) and the larger one's first 1 - t shingles
    have one in common, early enough for the rest to suffice. Two texts of the class that most texts at a
    shingle are in never meet.
    """
    t = F.lit(threshold)
    main = held.groupBy("token", "c").agg(F.count("*").alias("m")).groupBy("token").agg(F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("classes")).where("classes > 1").select("token", F.col("top.c").alias("main"))
    rows = staged(held.join(main, "token").withColumn("other", F.col("c") != F.col("main")).drop("main"))
    reach = F.col("n") - F.ceil(2 * t / (1 + t) * F.col("n") - 1e-6) + 1
    left, right = (df.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("k", "n", "at", "c", "other"))) for s, df in (("a", rows.where(F.col("at") < reach)), ("b", rows)))
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = (F.col("c_a") != F.col("c_b")) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("k_a") < F.col("k_b")))) & (F.col("n_a") >= t * F.col("n_b") - 1e-6) & (rest >= t / (1 + t) * (F.col("n_a") + F.col("n_b")) - 1e-6)
    met = [a.join(b, (a["token"] == b["token"]) & fits).select(*_ordered("k_a", "k_b")) for a, b in ((left.where("other_a"), right), (left.where("not other_a"), right.where("other_b")))]
    return met[0].unionByName(met[1]).distinct()


def links(texts: DataFrame, threshold: float) -> DataFrame:
    """``(src, dst)``, alike pairs whose components are those of all alike pairs of ``texts``.

    texts: ``(k, n, parts, parity, shingles, prefix, rare)``, each word sequence once.
    """
    found = staged(alike(staged(ball_pairs(texts)), texts, threshold))
    classes = _classes(found)
    tokens = staged(shared_prefixes(texts, classes))
    tried = made = None
    for turn in range(ROUNDS):
        pairs = class_pairs(_with_class(tokens, classes), threshold, turn, made)
        pairs = staged(pairs if tried is None else pairs.join(tried, ["src", "dst"], "left_anti"))
        new = staged(alike(pairs, texts, threshold))
        linked = new.count()
        if not linked:
            break
        found = found.unionByName(new)
        classes, made = _joined(classes, new)
        if linked * PAYS < pairs.count():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
    pairs = staged(prefix_pairs(_with_class(tokens, classes), threshold))
    return found.unionByName(staged(alike(pairs, texts, threshold)))


def grouped(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """``(k, doc_id, t1, t2, c)`` for each row with an id: its number, what tells it from others, its class."""
    ship(docs.sparkSession)
    rows = staged(profiles(docs.where("doc_id is not null").select("doc_id", "text"), size, threshold))
    first = staged(rows.groupBy("s1", "s2").agg(F.min("k").alias("head")))
    slim = staged(rows.select("k", "doc_id", "t1", "t2", "s1", "s2").join(first, ["s1", "s2"]).drop("s1", "s2"))
    texts = rows.select("k", "n", "parts", "parity", "shingles", "prefix", "rare").join(slim.where("k <> head").select("k"), "k", "left_anti")
    classes = _classes(links(texts, threshold)).withColumnRenamed("k", "head")
    return staged(slim.join(classes, "head", "left").select("k", "doc_id", "t1", "t2", F.coalesce("c", "head").alias("c")))


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, class_id)``: classes of texts linked by a Jaccard likeness of word shingles of ``threshold`` or more.

    One row for each row with an id. Words are parted by white space, A-Z in lower case; a text of fewer than
    ``size`` words is one shingle; texts of equal words are alike, so those without words are (null counts as
    empty). ``class_id`` is the least doc_id of the class. Rows without an id take no part; rows that repeat an
    id are texts of their own; an empty table gives no rows. Texts of any length are compared whole.
    """
    rows = grouped(docs, size, threshold)
    named = rows.groupBy("c").agg(F.min("doc_id").alias("class_id"))
    return rows.select("doc_id", "c").join(named, "c").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the least doc_id stays.

    Of several texts of that id in one class one stays, of repeated rows (equal id and text) one too; rows
    without an id all stay. Other columns, whatever their names, are kept as they are.
    """
    rows = grouped(docs, size, threshold)
    best = rows.groupBy("c").agg(F.min(F.struct("doc_id", "t1", "t2", "k")).alias("b"))
    marked = rows.join(best, "c").withColumn("kept", F.struct("doc_id", "t1", "t2") == F.struct("b.doc_id", "b.t1", "b.t2"))
    key = ["doc_id", "t1", "t2"]
    drop = staged(marked.where("not kept").select(*key).distinct())
    again = staged(marked.where("kept and k <> b.k").select(*key).distinct())
    text = [docs["doc_id"] == F.col("r.doc_id"), F.xxhash64(docs["text"]) == F.col("r.t1"), F.xxhash64(F.lit(7), docs["text"]) == F.col("r.t2")]
    left = docs.join(drop.alias("r"), text, "left_anti")
    if again.isEmpty():
        return left
    twice = left.join(again.alias("r"), text, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again.alias("r"), text, "left_anti").unionByName(twice)
