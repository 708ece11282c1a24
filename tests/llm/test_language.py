import random
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from voxelgraph.llm import language

WORDS = {"en": "the and of that with this house water strength", "de": "der und nicht straße wasser schön über haus", "fr": "le et être même eau maison façon très"}


def runs_by_hand(text):
    """All runs of up to three letters, over words kept apart by one blank."""
    if not any(c.isalpha() for c in text):
        return set()
    s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def texts(rng, n, words=12):
    return [(i, " ".join(rng.choices(WORDS[lang].split(), k=words)), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


@pytest.mark.parametrize("text", ["", " 12! ", "a", "Ab  c-D", "ÀÉ\u0000\tß𝒳ı", "x" * 50, "ab ab ab", "\U00010400 İ"])
def test_runs_by_hand(text):
    decoded = {"".join(chr((r >> s & (1 << 21) - 1) - 1) for s in (42, 21, 0) if r >> s) for r in language.runs(text).tolist()}
    assert decoded == runs_by_hand(text)


def test_kernel_against_sets():
    rng = random.Random(1)
    all_ = [t for _, t, _ in texts(rng, 40)] + ["", "zzz qqq"]
    marks = language.Landmarks([language.runs(t) for t in all_[:7]])
    got = marks.kernel([language.runs(t) for t in all_])
    sets = [runs_by_hand(t) for t in all_]
    want = [[len(a & b) / max(1, len(a)) ** 0.5 / max(1, len(b)) ** 0.5 for b in sets[:7]] for a in sets]
    assert np.allclose(got, want, atol=1e-6)


def test_regression_against_the_kernel_form():
    """With every training text as a landmark Nyström is exact: scores are those of kernel ridge regression itself."""
    rng = random.Random(2)
    rows = texts(rng, 60, 30)
    found = [language.runs(t) for _, t, _ in rows]
    marks = language.Landmarks(found)
    k, langs = marks.kernel(found), [lang for *_, lang in rows]
    model = language.regression(marks, langs, k, 1e-2)
    names = sorted(WORDS)
    y = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    w = (y > 0) @ (len(langs) / len(names) / (y > 0).sum(0))
    # minimise sum w (y - K a - b)^2 + ridge n a' K a, solved for a and b at once
    n = len(langs)
    full = np.block([[np.diag(w) @ k + 1e-2 * n * np.eye(n), w[:, None]], [w[None] @ k, np.array([[w.sum()]])]])
    solved = np.linalg.solve(full, np.vstack([w[:, None] * y, w[None] @ y]))
    assert np.allclose(k @ model.weights + model.bias, k @ solved[:-1] + solved[-1], atol=2e-3)


def test_query_on_the_smallest_tables(spark):
    rows = language.op11_language(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not runs_by_hand(docs[r.doc_id].text or "")) for r in rows)
    asked = [r for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und" and len(docs[r.doc_id].text) > 20]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in asked) / len(asked) > 0.95


def test_nulls_empty_long_repeated_and_clashing(spark):
    rng = random.Random(3)
    rows = texts(rng, 300)
    odd = [(1001, None, "en"), (1002, "", "en"), (1003, "12 - 34", None), (None, "the water of the house", "en"), (1005, "der straße " * 40_000, None), (1006, "the house", None), (1006, "the house", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "runs": F.lit(1), "lang_pred": F.lit(2), "place": F.lit(3)})
    got = language.identified(docs, language.fitted(docs)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert len(got) == len(rows) + len(odd) and len(by[1006]) == 2 and by[1006][0] == by[1006][1]
    assert by[1001] == by[1002] == by[1003] == [("und", 0.0)]
    assert by[None][0][0] == "en" and by[1005][0][0] == "de"
    assert sum(by[i][0][0] == lang for i, _, lang in rows) > 0.97 * len(rows)


def test_nothing_to_learn_from_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "the house", None), (2, "x", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identified(rows, language.fitted(rows)).collect()} == {("und", 0.0)}
    none = rows.limit(0)
    assert language.identified(none, language.fitted(none)).count() == 0
    one = spark.createDataFrame([(i, "the house of water", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identified(rows, language.fitted(one)).collect()} == {"en"}


def test_the_sample_is_bounded_and_has_every_language(spark):
    docs = spark.createDataFrame([(i, f"t{i} x", "big" if i % 50 else "small") for i in range(5000)] + [(7, "same", "big")] * 3000, "doc_id long, text string, lang string")
    counts = {r["lang"]: r["count"] for r in language.sample(docs, 100).groupBy("lang").count().collect()}
    assert 30 <= counts["big"] <= 180 and counts["small"] == docs.where("lang = 'small'").where(~language.held_out(F.col("doc_id"))).count()
