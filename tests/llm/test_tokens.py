import random
from collections import Counter

from conftest import SF
from pyspark.sql import functions as F

from voxelgraph.llm import token_counts, tokens


def test_ids_are_those_of_the_files_own_tokenizer(spark):
    e, rng = tokens.encoder(tokens.vocabulary_path()), random.Random(1)
    parts = [" ", "  ", "\n", "a", "B", "9", "é", ".", "\t", "'s", " ", "　", "\x1c", "漢", "<|endoftext|>", " x", "z ", "\r\n", "🙂", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for t in texts:
        assert e.ids(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_histogram_and_limits_against_python(spark):
    rng = random.Random(2)
    lengths = [rng.choice([0, 1, 5, 255, 256, 257, 1000, 5000]) for _ in range(500)] + [7] * 300
    h = token_counts.length_histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens bigint"))
    rows = {r.n_tokens: r for r in h.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(lengths)
    for k, r in rows.items():
        assert r.docs_within == sum(x <= k for x in lengths) and r.docs_over == sum(x > k for x in lengths)
        assert r.tokens_within == sum(x for x in lengths if x <= k) and r.tokens_over == sum(x for x in lengths if x > k)
        assert r.truncated_total == sum(min(x, k) for x in lengths) and r.lost_tokens == sum(max(x - k, 0) for x in lengths)
    for r in token_counts.at_limits(h, [3, 300]).collect():
        assert r.truncated_total == sum(min(x, r.limit) for x in lengths) and r.docs_over == sum(x > r.limit for x in lengths)
    q = {r.probability: r.n_tokens for r in token_counts.quantiles(h, [0.5, 1.0]).collect()}
    assert q == {0.5: sorted(lengths)[399], 1.0: 5000}


def test_nulls_and_no_rows(spark):
    docs = spark.createDataFrame([(None, 1), ("", 2), ("a a", 3)], "text string, n_tokens int")
    assert sorted(r.n_tokens for r in token_counts.token_lengths(docs).collect()) == [0, 0, 2]
    assert token_counts.length_histogram(token_counts.token_lengths(docs.limit(0))).count() == 0


def test_query(spark):
    e = tokens.encoder(tokens.vocabulary_path())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    total = token_counts.op5_token_counts(spark, SF).agg(F.sum(F.col("n_docs") * F.col("n_tokens"))).first()[0]
    assert total == sum(len(e.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts)


def test_very_long_texts_and_clashing_names(spark):
    docs = spark.createDataFrame([("a " * 60_000, 5, 6, "x"), ("b", 7, 8, "y")], "text string, n_tokens int, n_docs int, token string")
    lengths = sorted(r.n_tokens for r in token_counts.token_lengths(docs).collect())
    assert lengths == [1, len(tokens.encoder(tokens.vocabulary_path()).ids("a " * 60_000))]
    assert token_counts.length_histogram(token_counts.token_lengths(docs)).count() == 2
