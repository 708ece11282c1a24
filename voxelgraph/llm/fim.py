"""Fill-in-the-middle: a text cut in three and put together in another order.

A text's units (words of ASCII letters, and every other code point) are the lowest lane of an indexable skip
list; each express lane above links over ``FAN`` links of the one below. A link carries how many units and how many
code points it spans, so a descent from the top lane that adds up widths reaches the rank of a cut, and the place
in the text comes with it. Texts are whole and cut where they are read: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgraph.llm.tokens import text_of
from voxelgraph.session import ship, table

#: Links of a lane that one link of the lane above spans.
FAN = 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT = "doc_id {id}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class SkipList:
    """The units of a text under express lanes; every lane has (units, code points) of each of its links."""

    def __init__(self, text: str):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        low = c | 32
        letter = (low >= 97) & (low <= 122) & (c < 128)
        start = ~letter
        start[1:] |= ~letter[:-1]
        start[:1] = True
        at = np.flatnonzero(start)
        units, chars = np.ones(len(at), "i8"), np.diff(at, append=len(c))
        self.n, self.lanes = len(at), [(units, chars)]
        while len(units) > FAN:
            first = np.arange(0, len(units), FAN)
            units, chars = np.add.reduceat(units, first), np.add.reduceat(chars, first)
            self.lanes.append((units, chars))

    def place(self, rank: int) -> int:
        """Code points before the unit of this rank (all for the rank after the last)."""
        link, passed, place = 0, 0, 0
        for units, chars in reversed(self.lanes):
            while link < len(units) and passed + units[link] <= rank:
                passed, place, link = passed + units[link], place + chars[link], link + 1
            link *= FAN
        return int(place)


def arranged(prefix: str, middle: str, suffix: str, form: str) -> str:
    """The three parts as ``psm`` or ``spm``."""
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def form_of(text: Column, plain: Column, spm: Column) -> Column:
    """``plain`` for an empty text, one that holds a mark, or where ``plain`` says so; else ``spm`` or ``psm``."""
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    return F.when((text == "") | marked | plain, "plain").when(spm, "spm").otherwise("psm")


def transformed(docs: DataFrame, first: Column, second: Column, form: Column) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs`` (``doc_id, text``).

    With n units, the cuts are before units ``first % (n + 1)`` and ``second % (n + 1)`` (whole numbers, not
    negative), the smaller one first. A null text is an empty one. ``plain`` rows keep their text and have no
    widths.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, a, b, kind in zip(*(batch.column(k) for k in range(1, 5)), strict=True):
                text, kind = text.as_py(), kind.as_py()
                units = SkipList(text)
                if kind == "plain":
                    rows.append((units.n, None, None, text))
                    continue
                ranks = sorted(x.as_py() % (units.n + 1) for x in (a, b))
                lo, hi = map(units.place, ranks)
                rows.append((units.n, lo, hi - lo, arranged(text[:lo], text[lo:hi], text[hi:], kind)))
            n, lo, mid, out = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(4), pa.array(lo, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    held = docs.select("doc_id", text_of().alias("text"), first.cast("bigint").alias("first"), second.cast("bigint").alias("second"), form.alias("form"))
    return held.mapInArrow(run, CUT.format(id=docs.schema["doc_id"].dataType.simpleString()))


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output: a text with marks of its own is always ``plain``, so each mark stands once."""
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    after = lambda at: F.substr(output, at + 3)
    between = lambda at, end: F.substr(output, at + 3, end - at - 3)
    psm, spm = F.concat(between(p, s), after(m), between(s, m)), F.concat(between(p, m), after(m), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def rolls(doc_id: Column, key: int = 1) -> list[Column]:
    """Four whole numbers below 2^32 for each document: groups of eight digits of the sha256 of ``key:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{key}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` cut and arranged, with digests of the output and of the text rebuilt from it.

    One row for each row: equal rows have equal results, a null id counts as an empty one, a null text is an
    empty one (``plain``, n 0); texts of any length are cut whole; equal cuts leave an empty middle; an empty
    table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    h1, h2, h3, h4 = rolls(F.col("doc_id"))
    out = transformed(docs, h1, h2, form_of(text_of(), h3 % 100 >= 90, h4 % 100 < 20))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
    CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi
  FROM h),
p AS (
  SELECT doc_id, t, n, form, array_to_string(list_slice(u, 1, lo), '') AS a, array_to_string(list_slice(u, lo + 1, hi), '') AS b, array_to_string(list_slice(u, hi + 1, n), '') AS c
  FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
