import math
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from voxelgraph.llm import near_dedup, pii, simhash
from voxelgraph.session import staged

SF = "/root/testdata/sf0.01"


def shingles(text):
    return set(simhash.shingles_of(simhash.words_of(text or ""), 5))


def classes(texts):
    comp = {i: i for i in texts}
    sets = {i: (shingles(t), simhash.words_of(t or "")) for i, t in texts.items()}
    ids = sorted(texts)
    pairs = [(a, b) for a in ids for b in ids if a < b and (sets[a][1] == sets[b][1] or (sets[a][0] | sets[b][0]) and len(sets[a][0] & sets[b][0]) >= 0.8 * len(sets[a][0] | sets[b][0]))]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return comp


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return out


def test_quality_keeps_good_and_drops_bad(spark, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = after.select("doc_id", F.lit(1).alias("k"))
    rows = labels.join(before.select("doc_id"), "doc_id").join(kept, "doc_id", "left").collect()
    good, bad = [r.k == 1 for r in rows if r.quality == 1], [r.k == 1 for r in rows if r.quality == 0]
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.1 * len(bad) and after.columns == before.columns


def test_dedup_keeps_one_of_each_class(stages):
    _, before, after = stages[1]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == set(classes(texts).values()) and after.columns == before.columns


def test_pii_changes_personal_data_only(stages):
    _, before, after = stages[2]
    a, b = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}
    changed = {i for i in a if a[i] != b[i]}
    found = {r.doc_id for r in pii.pseudonymised(before, pii.QUERY_KEY).where(F.size("pii_kinds") > 0).collect()}
    assert set(a) == set(b) and changed == found and 0 < len(changed) < 0.2 * len(a)


def test_mixing_samples_and_packing_keeps_every_document(stages):
    _, before, after = stages[3]
    assert 0.6 < after.count() / before.count() < 1
    _, docs, packed = stages[4]
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_duplicates_of_crowds_and_chains(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, n = {}, 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(rng.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[n := n + 1] = " ".join(w)
    texts |= {1000: "", 1001: None, 1002: "Two words", 1003: "two  WORDS", 1004: "x " * 30_000}
    df = spark.createDataFrame(list(texts.items()) + [(None, "w1")], "doc_id long, text string")
    got, want = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}, classes(texts)
    assert {i: c for i, c in got.items() if i in want} == want and got[1003] == got[1002] == 1002 and got[1001] == got[1000] == 1000
    twice = df.unionByName(df).where("doc_id in (1002, 1003) or doc_id is null")
    assert [r.doc_id for r in near_dedup.one_of_each(twice).orderBy("doc_id").collect()] == [None, None, 1002]
    assert near_dedup.one_of_each(df.limit(0)).count() == 0


def test_crowd_of_texts_that_are_alike_in_few_pairs(spark):
    # one text's edits: most pairs stay below the threshold, those that reach it are to be found among all
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([3, 5, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(400)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == classes(texts)


def test_rounds_end_with_one_that_links_few_of_its_pairs(spark, monkeypatch):
    # a crowd whose pairs mostly stay below the threshold: every round costs the driver queries and spares the enumeration little
    rng = random.Random(21)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([3, 5, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(400)}"
        texts[i] = " ".join(w)
    turns, real = [], near_dedup.class_pairs
    monkeypatch.setattr(near_dedup, "class_pairs", lambda *a: turns.append(a[2]) or real(*a))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == classes(texts)
    assert 0 < len(turns) < 3


def prefixes(sets, threshold=0.8):
    """The first shingles of each set in ascending order, as many as the filter needs."""
    return [(x, i, len(s), at, i % 7) for i, s in sets.items() for at, x in enumerate(sorted(s)[: len(s) - math.ceil(threshold * len(s) - 1e-6) + 1])]


def test_prefix_pairs_against_all_pairs(spark):
    rng = random.Random(12)
    sets = {i: rng.sample(range(60), rng.choice([5, 9, 10, 11, 20])) for i in range(150)}
    for i in range(150, 260):
        s = list(sets[rng.randrange(i)])
        for _ in range(rng.choice([0, 1, 2])):
            s[rng.randrange(len(s))] = rng.randrange(60, 90)
        sets[i] = list(set(s))
    held = spark.createDataFrame(prefixes(sets), "token long, k long, n int, at int, c long")
    got = {(r.src, r.dst) for r in near_dedup.prefix_pairs(held, 0.8).collect()}
    alike = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    want = {(a, b) for a in sets for b in sets if a < b and a % 7 != b % 7 and alike(a, b)}
    assert want and want <= got and all(a % 7 != b % 7 for a, b in got)


def test_joined_rows_of_a_crowd_grow_with_it_and_not_with_its_square(spark):
    # copies of one text with up to four words changed: many pairs are alike, many nearly so
    rng = random.Random(14)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(3000):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    made = {}
    for n in (1000, 3000):
        docs = spark.createDataFrame(texts[:n], "doc_id long, text string")
        rows = staged(near_dedup.profiles(docs, 5, 0.8))
        pairs = near_dedup.ball_pairs(rows)
        groups = near_dedup._classes(staged(near_dedup.alike(pairs, rows, 0.8)))
        held = staged(near_dedup._with_class(near_dedup.shared_prefixes(rows, groups), groups))
        made[n] = pairs.count(), held.count(), near_dedup.class_pairs(held, 0.8, 0).count()
    some = spark.createDataFrame(texts[:600], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(some).collect()} == classes(dict(texts[:600]))
    assert made[3000][0] < 2 * near_dedup.PARTS * 3000 and all(b < 4 * a + 1000 for a, b in zip(*made.values(), strict=True))


def test_one_id_on_two_texts_repeated_rows_and_clashing_names(spark):
    names = "doc_id long, text string, k long, c string, r string, t1 long, s1 long, head long, `b` long"
    extra = (1, "x", "y", 2, 3, 4, 5)
    rows = [(3, "one two three four five six", *extra), (5, "One two three four five  six", *extra), (5, "quite another text of eight words or so", *extra)]
    docs = spark.createDataFrame(rows + rows[2:], names)
    kept = near_dedup.one_of_each(docs)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, rows[0][1]), (5, rows[2][1])] and kept.columns == docs.columns
    text = spark.createDataFrame([("b", "x y"), ("a", "X Y"), ("c", None)], "doc_id string, text string")
    assert sorted(r.doc_id for r in near_dedup.one_of_each(text).collect()) == ["a", "c"]


def test_copies_that_differ_in_a_block(spark):
    # extended, truncated and shifted copies: their words differ about as much as their shingles
    rng = random.Random(13)
    texts, n = {}, 0
    for k in range(90):
        j, size = (0.8, 0.82, 0.85, 0.9)[k % 4], rng.choice([60, 150, 400])
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        new = lambda m: [f"v{rng.randrange(10**6)}" for _ in range(m)]
        extended = base + new(int((size - 4) / j) + 4 - size)
        cut = base[: -int((size - 4) * (1 - j))]
        m = int((size - 4) * (1 - j) / (1 + j))
        for w in (base, (extended, cut, base[m:] + new(m))[k % 3]):
            texts[n := n + 1] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = classes(texts)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == want and len(set(want.values())) == 90
