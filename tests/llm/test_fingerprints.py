import base64
import hashlib
import random

import numpy as np
from conftest import SF

from voxelgraph.llm import fingerprints as fp


def jaccard(a, b):
    a, b = set(fp.PARAGRAPH.findall(a)), set(fp.PARAGRAPH.findall(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs):
    order = sorted(docs, key=lambda i: -i)
    out = {}
    for k, i in enumerate(order):
        text, following = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 3
        changed = text[: len(text) - cut] + following[:cut]
        out[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), jaccard(text, changed), jaccard(text, following))
    return out


def as_rows(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect()}


def test_query_against_sets(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = fp.op6_fingerprints(spark, SF)
    assert as_rows(rows) == expected(docs)
    prints = {r.doc_id: r.fingerprint for r in rows.collect()}
    assert all((prints[a] == prints[b]) for a in docs for b in docs if docs[a] == docs[b])
    assert len(set(prints.values())) == len({frozenset(fp.PARAGRAPH.findall(t)) for t in docs.values()})


def test_small_buckets_sparse_ids_nulls_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET", 3)
    rng = random.Random(1)
    docs = {rng.randrange(10**9): "".join(rng.choice("ab.\né ") for _ in range(rng.choice([0, 1, 5, 90]))) for _ in range(40)}
    docs |= {10**9 + 1: None, 10**9 + 2: "x" * 50_000, 5: ""}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert as_rows(fp.fingerprinted(df)) == expected(docs)
    assert fp.fingerprinted(df.limit(0)).count() == 0
    one = fp.fingerprinted(spark.createDataFrame([(7, "a.b.c")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_peeling_reads_out_every_difference():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 2**63, 5000).astype("<u8")
    left = [np.concatenate([common, rng.integers(0, 2**63, k).astype("<u8")]) for k in (0, 1, 10, 400)]
    right = [np.concatenate([common, rng.integers(0, 2**63, k).astype("<u8")]) for k in (0, 0, 3, 900)]
    want = [5000 / len(set(a.tolist()) | set(b.tolist())) for a, b in zip(left, right)]
    assert np.allclose(fp.likeness(left, right), want, atol=0, rtol=1e-12)
    assert len(base64.b64decode(fp.sketches([common[:50]]).written()[0])) == fp.CELLS * 16  # 4 bytes of count, 8 of key, 4 of check


def test_ids_far_from_all_others_and_over_the_whole_range(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET", 8)
    ids = [-(2**63), *range(500), 2**62, 2**63 - 1, None, None]
    docs = spark.createDataFrame([(i, f"text {k}. more", "x", 1) for k, i in enumerate(ids)], "doc_id long, text string, bucket string, place int")
    rows = fp.fingerprinted(docs).collect()
    order = sorted((k for k, i in enumerate(ids) if i is not None), key=lambda k: -ids[k]) + [k for k, i in enumerate(ids) if i is None]
    follows = {order[k]: order[(k + 1) % len(order)] for k in range(len(order))}
    want = sorted((str(ids[k]), hashlib.sha256(fp.edited(f"text {k}. more", f"text {n}. more").encode()).hexdigest()) for k, n in follows.items())
    assert sorted((str(r.doc_id), r.edited_sha256) for r in rows) == want


def test_repeated_ids_follow_each_other_by_their_texts(spark):
    docs = spark.createDataFrame([(1, "b one"), (1, "a two"), (1, "a two"), (0, "c")], "doc_id long, text string")
    want = sorted(hashlib.sha256(fp.edited(a, b).encode()).hexdigest() for a, b in (("a two", "a two"), ("a two", "b one"), ("b one", "c"), ("c", "a two")))
    assert sorted(r.edited_sha256 for r in fp.fingerprinted(docs).collect()) == want
