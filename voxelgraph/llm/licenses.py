"""License scans as an exact set-similarity join between text blocks and license templates.

Templates are whole license texts and notices; a template is the set of its pairs of consecutive words. A
block is a window of a text a quarter longer than the template, and it matches if it contains at least a
threshold share of the template's pairs: that containment alone decides, and is its score. Windows start at every
place of a pair that the template has, so no match depends on how a text happens to be cut.

Sister licenses contain most of each other, so their blocks match together. Blocks of one template that follow
each other are a stretch; of overlapping stretches of sisters the one names the license that has most pairs beyond
those it lacks, and where that is equal, the one with the pairs of its own name and without those of a sister.

The join is the prefix-filter join for sets: a template's pairs are ordered by how often they occur in the
corpus, rarest first; a text can only match if it has one of the template's first pairs (prefix filter), enough
of its different pairs (length filter) and places enough between the first and the last of them in that order
(positional filter). What passes is verified block by block. A text is taken apart only if it has a word of some
pairs of which every match has one.

Everything is built from DataFrame functions. Only the template index is broadcast: its size is that of the
template list, a parameter.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelgraph.llm import license_texts
from voxelgraph.llm.tokens import text_of
from voxelgraph.session import staged, table

#: Phrases looked for word by word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Share of a template's pairs that a block must contain.
THRESHOLD = 0.8
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Parts that a template's pair plays: one of many, one that can't lack, one that mustn't be there.
PLAIN, NEEDED, ABSENT = 0, 1, 2


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case: runs of digits, letters and all characters beyond ASCII."""
    spaced = F.trim(F.translate(F.regexp_replace(text, NO_WORD, " "), *LETTERS))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def places(found: str, phrase: str) -> Column:
    """Starts of a phrase in an array of words, from 0."""
    parts = phrase.split()
    same = " and ".join(f"get({found}, i + {k}) <=> '{p}'" for k, p in enumerate(parts))
    # the cheap test first: nearly all texts lack the phrase's rarest word
    rare = max(parts, key=len)
    return F.expr(f"if(array_contains({found}, '{rare}'), filter(sequence(0, size({found}) - 1), i -> {same}), cast(array() as array<int>))")


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values))


def _own_pairs(text: str, absent: tuple[str, ...]) -> set[str]:
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    return {f"{a} {b}" for a, b in zip(found, found[1:])} - set(absent)


def _flags(templates, threshold: float) -> set[str]:
    """Words of which every match has one: long words from so many pairs that a match can't lack them all."""
    out = set()
    for _, text, _, absent in templates:
        own = _own_pairs(text, absent)
        words_of = sorted((max(p.split(), key=lambda w: (len(w), w)) for p in own), key=lambda w: (-len(w), w))
        out.update(words_of[: len(own) - math.ceil(round(threshold * len(own), 9)) + 1])
    return out


def sisters(templates) -> list[tuple[int, int]]:
    """(template, one of another label that has at least half of its pairs)."""
    own = [_own_pairs(text, absent) for _, text, _, absent in templates]
    return [(a, b) for a, x in enumerate(own) for b, y in enumerate(own) if templates[a][0] != templates[b][0] and 2 * len(x & y) >= len(x)]


def prepared(templates, threshold: float) -> tuple[list[tuple], list[tuple]]:
    """(template, label, pairs, least, span, needed) and (template, pair, part) of templates as the list has them."""
    rows, pairs = [], []
    for k, (label, text, needed, absent) in enumerate(templates):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        different = _own_pairs(text, absent)
        if not different or not needed or not set(needed) <= different:
            raise ValueError(f"template {k} ({label}) lacks a pair that it needs")
        rows.append((k, label, len(different), math.ceil(round(threshold * len(different), 9)), len(found) + len(found) // 4 + 1, len(set(needed))))
        pairs += [(k, p, NEEDED if p in needed else PLAIN) for p in sorted(different)] + [(k, p, ABSENT) for p in sorted(set(absent))]
    return rows, pairs


def pair_places(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(row_id, pos, pair)`` of the pairs of consecutive words that any template knows; texts: ``(row_id, w)``."""
    both = F.expr("transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))")
    every = texts.where(F.size("w") > 1).select("row_id", F.posexplode(both).alias("pos", "pair"))
    return every.join(F.broadcast(pairs.select("pair").distinct()), "pair").select("row_id", "pos", "pair")


def matching_blocks(places: DataFrame, rows: list[tuple], pairs: list[tuple], near: list[tuple[int, int]]) -> DataFrame:
    """``(row_id, label, containment, named)`` for the labels of blocks that match; ``named``: not a sister's alone."""
    spark = places.sparkSession
    known = spark.createDataFrame(rows, "template int, label string, n int, least int, span int, needed int")
    listed = spark.createDataFrame(pairs, "template int, pair string, part int")
    counts = places.groupBy("pair").count()
    order = Window.partitionBy("template").orderBy(F.col("part") == ABSENT, F.coalesce("count", F.lit(0)), "pair")
    # the pairs of the templates: a bounded table
    index = listed.join(counts, "pair", "left").withColumn("place", F.row_number().over(order) - 1).join(known, "template").drop("count")
    hits = staged(places.join(F.broadcast(index), "pair"))
    mine = hits.where(F.col("part") != ABSENT)
    first = mine.groupBy("row_id", "template").agg(F.min("place").alias("place"), F.max("place").alias("last"), F.countDistinct("pair").alias("m"), F.first("n").alias("n"), F.first("least").alias("least"))
    able = first.where("place <= n - least and m >= least and last - place + 1 >= least").select("row_id", "template")
    held = hits.join(able, ["row_id", "template"], "left_semi")
    # frames about as wide as the templates: those of like span share one
    parts = []
    for bits in sorted({r[4].bit_length() for r in rows}):
        ahead = Window.partitionBy("row_id", "template").orderBy("pos").rangeBetween(0, max(r[4] for r in rows if r[4].bit_length() == bits) - 2)
        like = held.where((F.col("span") >= 1 << (bits - 1)) & (F.col("span") < 1 << bits))
        parts.append(like.withColumn("block", F.filter(F.collect_list(F.struct("pos", "place", "part")).over(ahead), lambda x: x["pos"] < F.col("pos") + F.col("span") - 1)))
    seen = reduce(DataFrame.unionByName, parts).where(F.col("part") != ABSENT)
    different = lambda ok: F.size(F.array_distinct(F.transform(F.filter("block", ok), lambda x: x["place"])))
    told = (different(lambda x: x["part"] == NEEDED) == F.col("needed")) & (different(lambda x: x["part"] == ABSENT) == 0)
    kept = seen.select("row_id", "template", "label", "pos", "span", "n", "least", different(lambda x: x["part"] != ABSENT).alias("m"), told.alias("told")).where("m >= least")
    along = Window.partitionBy("row_id", "template").orderBy("pos")
    begins = F.coalesce(F.col("pos") - F.lag("pos").over(along) > F.col("span"), F.lit(True)).cast("int")
    stretch = kept.withColumn("begins", begins).withColumn("stretch", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = stretch.groupBy("row_id", "template", "label", "stretch").agg(
        F.min("pos").alias("start"), F.max(F.col("pos") + F.col("span")).alias("end"), F.max(F.struct((2 * F.col("m") - F.col("n")).alias("gain"), "told")).alias("key"), F.max(F.col("m") / F.col("n")).alias("containment")
    )
    found = staged(found)
    beside = F.broadcast(spark.createDataFrame(near, "template int, sister int"))  # pairs of templates
    other = found.select("row_id", F.col("template").alias("sister"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("key").alias("k"))
    lost = found.join(beside, "template").join(other, ["row_id", "sister"]).where("start < e and s < end and key < k").select("row_id", "template", "stretch").distinct().withColumn("lost", F.lit(True))
    return found.join(lost, ["row_id", "template", "stretch"], "left").groupBy("row_id", "label").agg(F.max("containment").alias("containment"), F.bool_or(F.col("lost").isNull()).alias("named"))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """License phrases and templates in every whole text.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``. A null text is an
    empty one, with no words, no labels and score 0; repeated rows are scanned each on its own; an empty
    table gives no rows; other columns of ``docs``, whatever their names, are left out. ``score`` is 1 with a
    phrase, else the greatest containment that reaches the threshold (in whatever template), else 0.
    """
    phrases = phrases or PHRASES
    rows, pairs = prepared(templates or license_texts.TEMPLATES, threshold)
    flags = f"array({_quoted(_flags(templates or license_texts.TEMPLATES, threshold))})"
    split = docs.select("doc_id", words(text_of()).alias("w"))
    at = split.select("doc_id", F.size("w").alias("n_words"), *(places("w", p).alias(f"p{k}") for k, p in enumerate(phrases)), F.expr(f"if(arrays_overlap(w, {flags}), w, null)").alias("w"))
    starts = [F.col(f"p{k}") for k in range(len(phrases))]
    every = F.concat(*starts)
    named = F.array(*(F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(starts, phrases.values(), strict=True)))
    found = staged(
        at.select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            F.col("n_words").cast("bigint").alias("n_words"),
            F.size(every).cast("bigint").alias("n_base"),
            F.array_min(every).cast("bigint").alias("first_word"),
            F.array_max(every).cast("bigint").alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(named))).alias("base"),
            "w",
        )
    )
    listed = docs.sparkSession.createDataFrame(pairs, "template int, pair string, part int")
    at = staged(pair_places(found.where("w is not null").select("row_id", "w"), listed))
    matched = matching_blocks(at, rows, pairs, sisters(templates or license_texts.TEMPLATES))
    labels = matched.groupBy("row_id").agg(F.collect_set(F.when(F.col("named"), F.col("label"))).alias("more"), F.max("containment").alias("best"))
    none = F.array().cast("array<string>")
    return found.join(labels, "row_id", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against the phrases above and the templates of the list."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same by brute force: every window of every text against every template, no filter before it."""
    rows, pairs = prepared(license_texts.TEMPLATES, THRESHOLD)
    listed = ", ".join(f"({k}, '{label}', {n}, {least}, {span}, {needed})" for k, label, n, least, span, needed in rows)
    parts = ", ".join(f"({k}, '{p}', {part})" for k, p, part in pairs)
    near = ", ".join(f"({a}, {b})" for a, b in sisters(license_texts.TEMPLATES))
    phrases = ", ".join(f"('{label}', [{', '.join(repr(w) for w in p.split())}])" for p, label in PHRASES.items())
    return f"""
WITH spaced AS (
  SELECT doc_id, row_number() OVER () AS r, trim(translate(regexp_replace(coalesce(text, ''), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g'), '{LETTERS[0]}', '{LETTERS[1]}')) AS s
  FROM documents),
w AS MATERIALIZED (SELECT doc_id, r, CASE WHEN s = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(s, ' ') END AS w FROM spaced),
phrase(label, words) AS (VALUES {phrases}),
template(k, label, n, least, span, needed) AS (VALUES {listed}),
near(k, sister) AS (VALUES {near}),
pair(k, pair, part) AS (VALUES {parts}),
hit AS (
  SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(words)] = words)) AS i
  FROM w, phrase WHERE len(list_intersect(w, words)) = len(words)),
base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS base FROM hit GROUP BY r),
spots AS (SELECT r, i AS pos, w[i + 1] || ' ' || w[i + 2] AS pair FROM (SELECT r, w, unnest(range(len(w) - 1)) AS i FROM w) q),
placed AS MATERIALIZED (SELECT r, k, pos, pair, part FROM spots JOIN pair USING (pair)),
block AS (
  SELECT a.r, a.k, a.pos, count(DISTINCT CASE WHEN b.part <> {ABSENT} THEN b.pair END) AS m, count(DISTINCT CASE WHEN b.part = {NEEDED} THEN b.pair END) AS has, count(CASE WHEN b.part = {ABSENT} THEN 1 END) AS bad
  FROM placed a JOIN template t ON a.k = t.k JOIN placed b ON a.r = b.r AND a.k = b.k AND b.pos >= a.pos AND b.pos < a.pos + t.span - 1
  WHERE a.part <> {ABSENT} GROUP BY a.r, a.k, a.pos),
kept AS (
  SELECT r, k, label, n, m, span, pos, has = needed AND bad = 0 AS told FROM block JOIN template USING (k) WHERE m >= least),
turn AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY r, k ORDER BY pos) <= span THEN 0 ELSE 1 END AS begins FROM kept),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY r, k ORDER BY pos) AS stretch FROM turn),
found AS MATERIALIZED (
  SELECT r, k, label, stretch, min(pos) AS s, max(pos + span) AS e, max((2 * m - n) * 2 + CASE WHEN told THEN 1 ELSE 0 END) AS key, max(m / CAST(n AS DOUBLE)) AS c FROM numbered GROUP BY r, k, label, stretch),
lost AS (
  SELECT DISTINCT a.r, a.k, a.stretch FROM found a JOIN near x ON a.k = x.k JOIN found b ON a.r = b.r AND b.k = x.sister AND a.s < b.e AND b.s < a.e AND b.key > a.key),
more AS (
  SELECT f.r, list(DISTINCT f.label) FILTER (l.r IS NULL) AS more, max(f.c) AS best
  FROM found f LEFT JOIN lost l ON f.r = l.r AND f.k = l.k AND f.stretch = l.stretch GROUP BY f.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END :: DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


OP2_SQL = _sql()
