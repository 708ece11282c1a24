import random
import zlib
from collections import defaultdict

import numpy as np
from conftest import SF

from voxelgraph.llm import packing, tokens


def brute(places, penalties, length):
    at, best = [0, *places], [0]
    for j in range(1, len(at)):
        best.append(min(best[i] + length - (at[j] - at[i]) + penalties[j - 1] for i in range(j) if at[j] - at[i] <= length))
    return best[-1]


def test_queue_finds_the_cheapest_cuts():
    rng = random.Random(5)
    for _ in range(200):
        places = sorted(rng.sample(range(1, 200), 40))
        places = [p for p in places if p <= 30 or True]
        if max(b - a for a, b in zip([0, *places], places)) > 40:
            continue
        penalties = [rng.choice([0, 3, 20]) for _ in places]
        cuts = packing.cheapest_cuts(places, penalties, 40)
        cost = sum(40 - (b - a) + penalties[places.index(b)] for a, b in zip([0, *cuts], cuts))
        assert cuts[-1] == places[-1] and max(b - a for a, b in zip([0, *cuts], cuts)) <= 40
        assert cost == brute(places, penalties, 40)


def whole(rows, docs):
    e = tokens.encoder(tokens.vocabulary_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in docs.items():
        ids = np.array([*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return sum(r.length for r in rows) / (2048 * len(sequences))


def test_query_keeps_every_id_once(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert whole(packing.op7_packing(spark, SF).collect(), docs) > 0.97


def test_nulls_empty_and_very_long_texts(spark):
    docs = {1: None, 2: "", 3: "x" * 30_000, 4: "word " * 20_000}
    df = spark.createDataFrame([(k, v, "extra") for k, v in docs.items()], "doc_id long, text string, sequence_id string").coalesce(1)
    whole(packing.pack(df).collect(), docs)
    assert sum(len(r.ids) == r.length for r in packing.pack(df, keep_ids=True).collect()) > 10
    assert packing.pack(df.limit(0)).count() == 0


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "one two three", 0), (1, "one two three", 0), (2, "one two three", 0)], "doc_id long, text string, offset int").coalesce(1)
    rows = packing.pack(df).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 2] and len({(r.sequence_id, r.offset) for r in rows}) == 3 and len({r.ids_crc32 for r in rows}) == 1
