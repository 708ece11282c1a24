"""Every stage on nulls, empty and very long texts, repeated rows, empty tables and names that the stages use themselves."""

import corpus_pipeline
import pytest
from conftest import SF
from pyspark.sql import functions as F

#: Names that operators give their own columns.
CLASHING = ("k", "c", "row", "score", "topic", "kept", "shard", "slot", "tokens", "weights", "n", "t1", "label", "x")


@pytest.fixture(scope="module")
def odd(spark):
    plain = [(i, f"The house number {i} stands by the water, and people of the town {i * 7} walk there every day.", "en" if i % 2 else None, "web" if i % 3 else None, None) for i in range(1, 30)]
    more = [(None, "a text without an id, that nobody asked for", "en", "web", 5), (40, None, "en", "web", 3), (41, "", "de", "web", 0), (42, "long words " * 30_000, None, None, 1), (43, "twice the same row", "fr", "b", 1), (43, "twice the same row", "fr", "b", 1)]
    df = spark.createDataFrame(plain + more, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({name: F.lit(f"own {name}") for name in CLASHING})


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_rows_and_columns_stay_as_they_are(spark, odd, name, stage):
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns
    rows = out.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    before = {(r.doc_id, r.text, r.lang, r.source) for r in odd.collect()}
    if name == "pii":
        assert len(rows) == odd.count() and {r.doc_id for r in rows} == {i for i, *_ in before}
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None) and [r.n_chars for r in rows if r.text is None] == [3]
        assert len({r.text for r in rows if r.doc_id == 43}) == 1
    else:
        assert {(r.doc_id, r.text, r.lang, r.source) for r in rows} <= before
        assert len(rows) <= odd.count()
    if name == "near_dedup":
        assert [r.doc_id for r in rows].count(43) == 1 and None in {r.doc_id for r in rows}
        assert len({40, 41} & {r.doc_id for r in rows}) == 1  # texts without words are one group


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_empty_tables(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_pii_without_a_count_of_characters(spark, odd):
    assert corpus_pipeline.pii_stage(spark, odd.drop("n_chars"), SF).count() == odd.count()


def test_packing_covers_every_row(spark, odd):
    rows = corpus_pipeline.STAGES[-1][1](spark, odd, SF).collect()
    whole = {}
    for r in rows:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        assert r.offset + r.length <= 2048
    assert {i for i, _ in whole} == {r.doc_id for r in odd.collect()}
    for (i, n), pieces in whole.items():
        times = 2 if i == 43 else 1
        assert sum(length for _, length in pieces) == n * times and min(pieces)[0] == 0
    assert [n for (i, n) in whole if i in (40, 41)] == [1, 1]  # the end mark alone
