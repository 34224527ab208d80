"""Top-k search against a full scan."""

import numpy as np

from pathloom.llm.mtree import MTree, SearchConfig, top_k


def brute(ids, vectors, query_id, query, k):
    q = np.floor(64 * np.array(query))
    scored = sorted((-int(np.floor(64 * np.array(v)) @ q), i) for i, v in zip(ids, vectors) if i != query_id)
    return [(i, -s) for s, i in scored[:k]]


def test_equals_a_full_scan(spark):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(0, 0.2, (300, 8)), np.repeat(rng.normal(0, 0.2, (1, 8)), 300, 0), 3 * rng.normal(0, 0.2, (40, 8))]).tolist()
    rows = list(enumerate(vectors))
    odd = [(1000, None), (1020, [None] * 8), (1040, [float("nan")] + [0.0] * 7), (1060, [float("inf")] * 8), (1080, []), (1100, [1.0, 2.0]), (None, vectors[0])]
    frame = spark.createDataFrame(rows + odd, "id long, vector array<float>").repartition(3)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = {}
    for r in top_k(frame, frame.where("id % 20 = 0"), SearchConfig(block=128, min_blocks=2, queries=8, page=16, fanout=4)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    for query, found in got.items():
        want = brute(*zip(*rows), query, rows[query][1], 20)
        assert sorted(found) == [(n, i, s) for n, (i, s) in enumerate(want, 1)]
    assert top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_bounds_save_distances():
    rng = np.random.default_rng(0)
    centers = rng.normal(0, 1000, (20, 16))
    vectors = np.floor(np.repeat(centers, 100, 0) + rng.normal(0, 10, (2000, 16)))
    asked = np.arange(0, 2000, 50)
    single, batched = (MTree(vectors, np.arange(2000), SearchConfig(page=32)) for _ in range(2))
    many = batched.search_many(vectors[asked], asked)
    for i, together in zip(asked.tolist(), many):
        want = sorted((-int(v @ vectors[i]), j) for j, v in enumerate(vectors) if j != i)[:20]
        for ids, scores in (single.search(vectors[i], i), together):
            assert list(zip((-scores).tolist(), ids.tolist())) == want
    # of all distances to entries alone, each path computes a small share, centers included
    assert single.computed < len(asked) * 2000 / 4 and batched.computed < len(asked) * 2000 / 4


def test_stored_parent_distances_rule_children_out(monkeypatch):
    rng = np.random.default_rng(2)
    vectors = np.floor(np.repeat(rng.normal(0, 1000, (60, 8)), 50, 0) + rng.normal(0, 5, (3000, 8)))
    asked = np.arange(0, 3000, 100)
    tree = MTree(vectors, np.arange(3000), SearchConfig(page=64, fanout=4))
    want = tree.search_many(vectors[asked], asked)
    used, tree.computed = tree.computed, 0
    monkeypatch.setattr(np, "abs", lambda x: np.zeros_like(x))  # only the covering radii are left
    got = tree.search_many(vectors[asked], asked)
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(want, got))
    assert used < tree.computed


def test_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(9)
    rows = [(i % 30, rng.integers(-3, 4, 4).astype(float).tolist(), 5, 6) for i in range(90)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>, key int, block int")
    got = {}
    for r in top_k(frame, frame.where("id % 20 = 0"), SearchConfig(k=3, block=16, page=4)).collect():
        got.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    for query in (0, 20):
        asks = [v for i, v, *_ in rows if i == query]
        want = {}
        for q in asks:
            scored = sorted((-int(64 * 64 * np.dot(q, v)), i) for i, v, *_ in rows if i != query)[:3]
            for n, (s, i) in enumerate(scored, 1):
                want.setdefault(n, []).append((i, -s))
        assert {n: sorted(got[query, n]) for n in (1, 2, 3)} == {n: sorted(x) for n, x in want.items()}
    empty = spark.createDataFrame([(1, []), (2, []), (3, [1.0])], "id long, vector array<double>")
    assert sorted(map(tuple, top_k(empty, empty.where("id = 1")).collect())) == [(1, 1, 2, 0)]


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(0, 2.0**29, (200, 4)))
    tree = MTree(vectors, np.arange(200), SearchConfig(k=5, page=8))
    ids, scores = tree.search(vectors[3], 3)
    want = sorted((-sum(int(a) * int(b) for a, b in zip(v, vectors[3])), j) for j, v in enumerate(vectors) if j != 3)[:5]
    assert list(zip((-scores).tolist(), ids.tolist())) == want
