import random

import xxhash
from conftest import SF
from pyspark.sql import functions as F

from voxelgraph.llm import simhash


def by_hand(text, size):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius):
    """Least id reachable, over all pairs."""
    comp = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= radius and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def test_query_against_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = simhash.op8_simhash(spark, SF).collect()
    prints = {i: by_hand(t, 3) for i, t in docs.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == classes(prints, 2)


def test_chains_of_near_fingerprints(spark):
    rng, prints = random.Random(4), {}
    for i in range(150):
        base = rng.choice(list(prints.values())) if prints and rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
            base ^= 1 << b
        prints[i * 7 % 150] = base
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    for radius in (2, 4):
        got = simhash.components(spark.createDataFrame(signed, "doc_id long, fp long"), radius)
        assert {r.doc_id: r.component_id for r in got.collect()} == classes(prints, radius)


def test_nulls_empty_texts_and_no_rows(spark):
    docs = spark.createDataFrame([(3, None, "a"), (2, "", "b"), (None, "  ", "c"), (5, "One", "d"), (6, "one", "e")], "doc_id long, text string, fp string")
    rows = simhash.components(simhash.fingerprints(docs, 3), 2).select("doc_id", F.hex("fp").alias("fp"), "component_id").collect()
    assert {r.doc_id: r.component_id for r in rows} == {3: 2, 2: 2, None: 2, 5: 5, 6: 5} and {r.fp for r in rows if r.doc_id in (2, 3, None)} == {"0"}
    assert simhash.components(simhash.fingerprints(docs.limit(0), 3), 2).count() == 0


def test_repeated_rows_very_long_texts_and_clashing_names(spark):
    long = "lorem ipsum dolor sit amet " * 20_000
    docs = spark.createDataFrame([(4, long, "a", 1), (4, long, "b", 2), (9, long.upper(), "c", 3), (1, "quite another one", "d", 4)], "doc_id long, text string, fp string, component_id int")
    rows = simhash.components(simhash.fingerprints(docs, 3), 2).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (4, 4), (4, 4), (9, 4)]
    assert {r.fp for r in rows if r.doc_id > 1} == {int.from_bytes(by_hand(long, 3).to_bytes(8, "big"), "big", signed=True)}
