import random

from voxelgraph.llm import topk


def brute(rows, queries, k):
    out = {}
    for q, w in queries:
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_against_all_pairs_with_ties_ragged_and_sparse_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0, 0, 0, 1, -2, 5]) for _ in range(rng.choice([0, 3, 8]))]) for i in range(400)]
    queries = rows[::25]
    schema = "vec_id long, weights array<long>"
    got = topk.top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(queries + queries[:2], schema), 7).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by == brute(rows, queries, 7)


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(0, [1.0, 0.5]), (1, None), (2, [nan]), (3, [inf]), (4, [None]), (None, [1.0]), (5, [0.26]), (6, [])], "vec_id long, embedding array<float>")
    v = topk.whole_vectors(rows, "vec_id", "embedding", 64.0)
    assert {r.vec_id: list(r.weights) for r in v.collect()} == {0: [64, 32], 5: [16], 6: []}
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id = 0"), 20).collect()]
    assert sorted(got) == [(0, 1, 5, 1024), (0, 2, 6, 0)]
    assert topk.top_k(v.limit(0), v.limit(0), 20).count() == 0


def test_repeated_candidates_and_no_queries(spark):
    rows = [(1, [2, 0]), (2, [1, 1]), (2, [1, 1]), (3, [0, 0])]
    v = spark.createDataFrame(rows, "vec_id long, weights array<long>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id = 1"), 20).collect()]
    assert sorted(got) == [(1, 1, 2, 2), (1, 2, 2, 2), (1, 3, 3, 0)]
    assert topk.top_k(v, v.limit(0), 20).count() == 0
