"""Nearest vectors through cells against a comparison with all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators.cells import in_cells, open_cells, search
from pathloom.operators.locate import dense_top_k


def brute(queries, vectors, k):
    out = []
    for q, v in queries:
        if v is not None:
            scored = sorted((-round(float(np.dot(v, w)), 9), key) for key, w in vectors if w is not None)
            out += [(q, key, -s, rank) for rank, (s, key) in enumerate(scored[:k], 1)]
    return sorted(out)


def frames(spark, queries, vectors):
    as_list = lambda rows: [(i, None if v is None else [float(x) for x in v]) for i, v in rows]
    return spark.createDataFrame(as_list(queries), "q long, v array<double>"), spark.createDataFrame(as_list(vectors), "key long, v array<double>")


def same(found, want):
    got = sorted(map(tuple, found.collect()))
    assert [(q, k, r) for q, k, _, r in got] == [(q, k, r) for q, k, _, r in want]
    assert np.allclose([s for _, _, s, _ in got], [s for _, _, s, _ in want])


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 3
    vectors = [(i, centres[i % 12] + rng.normal(size=8) * 0.1) for i in range(900)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(300)] + [(2000, None)]  # a quarter of all rows are copies
    queries = [(i, centres[i] + rng.normal(size=8) * 0.1) for i in range(12)] + [(50, np.zeros(8)), (51, None)]
    return queries, vectors


@pytest.mark.parametrize("cells, part, probes", [(1, 4096, 1), (20, 50, 1), (20, 4096, 3), (None, 4096, 2)])
def test_equals_all_pairs(spark, clustered, cells, part, probes):
    queries, vectors = clustered
    asked, stored = frames(spark, queries, vectors)
    found, opened = search(asked, in_cells(stored, cells, part), 7, probes)
    same(found, brute(queries, vectors, 7))
    assert opened.where("round = 1").groupBy("q").count().agg(F.max("count")).first()[0] <= probes


def test_cells_are_ruled_out(spark, clustered, tmp_path):
    queries, vectors = clustered
    asked, stored = frames(spark, queries[:12], vectors)
    in_cells(stored, 24, 100).save(str(tmp_path / "cells"))
    cells = open_cells(spark, str(tmp_path / "cells"))
    assert cells.centres.agg(F.max("parts")).first()[0] > 1  # the copies' cell is dealt out
    found, opened = search(asked, cells, 5)
    same(found, brute(queries[:12], vectors, 5))
    assert opened.count() < 0.5 * 12 * cells.centres.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_few_and_none(spark):
    asked, stored = frames(spark, [(1, [1, 0]), (2, [0, 1])], [(7, [1, 1]), (3, [1, 1])])
    same(dense_top_k(asked, stored, 5), [(1, 3, 1.0, 1), (1, 7, 1.0, 2), (2, 3, 1.0, 1), (2, 7, 1.0, 2)])
    assert dense_top_k(asked, stored.where("key < 0"), 5).count() == 0
    assert dense_top_k(asked.where("q < 0"), stored, 5).count() == 0
