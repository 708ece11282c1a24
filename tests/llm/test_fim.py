import hashlib
import random
import re

import duckdb
from conftest import SF
from pyspark.sql import functions as F

from voxelgraph.llm import fim

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
ODD = ["", "a", "!", "abc", "ab-cd", "a\nb\r\n c", "äbc ß d𝒳e", "<P", "x<P>y", "a <S> b", "<M>", "<S", "S>", "\u0000a\u0000", "a" * 5000, "é " * 3000, "İKK"]


def test_places_against_a_scan():
    rng = random.Random(0)
    for text in ODD + ["".join(rng.choices("ab é-\n<SP>", k=rng.randint(1, 900))) for _ in range(20)]:
        units = UNITS.findall(text)
        found = fim.SkipList(text)
        assert found.n == len(units)
        for rank in {0, 1, len(units) // 3, len(units) - 1, len(units), *(rng.randint(0, len(units)) for _ in range(20))} - {-1}:
            if rank <= len(units):
                assert found.place(rank) == len("".join(units[:rank]))


def by_hand(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS.findall(text)
    lo, hi = sorted(v % (len(units) + 1) for v in h[:2])
    a, b, c = ("".join(units[i:j]) for i, j in ((0, lo), (lo, hi), (hi, len(units))))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out, widths = "plain", text, (None, None)
    elif h[3] % 100 < 20:
        form, out, widths = "spm", f"<S>{c}<P>{a}<M>{b}", (len(a), len(b))
    else:
        form, out, widths = "psm", f"<P>{a}<S>{c}<M>{b}", (len(a), len(b))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(units), form, *widths, digest(out), digest(text))


def test_query_by_hand_and_by_sql(spark):
    got = sorted(map(tuple, fim.op12_fim(spark, SF).collect()))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == sorted(by_hand(r.doc_id, r.text) for r in docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(fim.OP12_SQL).fetchall()) == got
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_odd_texts_nulls_repeats_and_clashing_names(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD * 4)] + [(None, "abc d"), (500, None), (3, "abc"), (3, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "form": F.lit(1), "output": F.lit(2), "first": F.lit(3)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:3], r[5])
    assert sorted(map(tuple, fim.op12_fim(spark, str(tmp_path)).collect()), key=key) == sorted((by_hand(*r) for r in rows), key=key)


def test_empty_table_and_all_cuts(spark):
    docs = spark.createDataFrame([(1, "ab, <c d")], "doc_id long, text string")
    form = fim.form_of(F.col("text"), F.lit(False), F.col("doc_id") % 2 == 0)
    assert fim.transformed(docs.limit(0), F.lit(1), F.lit(2), form).count() == 0
    every = docs.select(F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"), "text").select(F.col("k").cast("long").alias("doc_id"), "text")
    out = fim.transformed(every, F.col("doc_id") % 8, F.floor(F.col("doc_id") / 8), form)
    rows = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert {r.back for r in rows} == {"ab, <c d"} and {r.form for r in rows} == {"psm", "spm"} and {r.n for r in rows} == {7}
