"""The factorisation machine: its identity, its gradient, and held-out accuracy."""

import os
import zlib

import numpy as np
import pytest

from pathloom.llm.factor_quality import FactorConfig, FactorModel, features, fit_factor_model, gradient, raw_scores, score_quality

FOLDER = "/root/testdata/sf0.01"


def made(rng, n, size, k):
    lengths = rng.integers(1, 6, n)
    bounds = np.append(0, np.cumsum(lengths))
    index = np.concatenate([rng.choice(size, m, replace=False) for m in lengths])
    return bounds, index, rng.normal(size=bounds[-1]), rng.normal(size=size), rng.normal(size=(size, k))


def test_identity():
    """The linear-time scores are those of all pairs."""
    rng = np.random.default_rng(0)
    bounds, index, value, weights, factors = made(rng, 20, 12, 3)
    found, _ = raw_scores(0.3, weights, factors, bounds, index, value)
    for row, (a, b) in enumerate(zip(bounds, bounds[1:])):
        own = list(zip(index[a:b], value[a:b]))
        pairs = sum(x * y * factors[i] @ factors[j] for n, (i, x) in enumerate(own) for j, y in own[n + 1 :])
        assert found[row] == pytest.approx(0.3 + sum(weights[i] * x for i, x in own) + pairs)


def test_gradient():
    rng = np.random.default_rng(1)
    bounds, index, value, weights, factors = made(rng, 15, 10, 2)
    labels = rng.integers(0, 2, 15).astype(float)

    def loss(bias, weights, factors):
        raw, _ = raw_scores(bias, weights, factors, bounds, index, value)
        return np.mean(np.logaddexp(0, raw) - labels * raw)

    by_bias, by_weight, by_factor = gradient(0.1, weights, factors, bounds, index, value, labels)
    e = 1e-6
    assert by_bias == pytest.approx((loss(0.1 + e, weights, factors) - loss(0.1 - e, weights, factors)) / (2 * e), abs=1e-6)
    for i in range(10):
        step = np.zeros(10)
        step[i] = e
        assert by_weight[i] == pytest.approx((loss(0.1, weights + step, factors) - loss(0.1, weights - step, factors)) / (2 * e), abs=1e-6)
        for f in range(2):
            step = np.zeros((10, 2))
            step[i, f] = e
            assert by_factor[i, f] == pytest.approx((loss(0.1, weights, factors + step) - loss(0.1, weights, factors - step)) / (2 * e), abs=1e-6)


def test_features_do_not_depend_on_the_batch():
    texts = [b"", b"One two. Three!!\nfour | five", b" \n", b"ONE one ONE one"]
    config = FactorConfig(word_bits=6)
    rows = np.append(0, np.cumsum([len(t) for t in texts]))
    chars = np.array([0.0, np.nan, 2, 15])
    bounds, index, value = features(np.frombuffer(b"".join(texts), np.uint8), rows, chars, config)
    for i, t in enumerate(texts):
        own = features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), chars[i : i + 1], config)
        assert own[1].tolist() == index[bounds[i] : bounds[i + 1]].tolist() and np.allclose(own[2], value[bounds[i] : bounds[i + 1]])


def test_odd_rows(spark, odd_documents, no_documents):
    """Nulls, empty and long texts, repeated rows, no n_chars; a model without labels says one half."""
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = fit_factor_model(odd_documents, labels)
    rows = score_quality(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and {r["score"] for r in rows} == {0.5} and {r["predicted"] for r in rows} == {1}
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert score_quality(no_documents, model).count() == 0
    size = len(model.weights)
    own = FactorModel(0.1, np.full(size, -0.2), np.full((size, 8), 0.01), model.config)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in score_quality(odd_documents, own).collect())


def test_odd_labels(spark):
    """Null, repeated and contradicting labels; labels without documents; held-out labels teach nothing."""
    documents = spark.createDataFrame([(i, "good text, here." * 9 if i % 2 else "$$$ ### |||" * 9, i) for i in range(40)], "doc_id long, text string, n_chars int")
    labels = [(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (3, 1), (99, 0)]
    model = fit_factor_model(documents, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {r["doc_id"]: r["predicted"] for r in score_quality(documents, model).collect()} == {i: i % 2 for i in range(40)}
    turned = [(i, 1 - q if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and q is not None else q) for i, q in labels]
    again = fit_factor_model(documents, spark.createDataFrame(turned, "doc_id long, quality int"))
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.factors, again.factors)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    """Also without regard to source and language, which take no part."""
    documents, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_factor_model(documents, labels)
    found = {r["doc_id"]: r for r in score_quality(documents.drop("source", "lang"), model).collect()}
    assert len(found) == documents.count()
    held = [(found[r["doc_id"]], r["quality"]) for r in labels.collect() if found[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and sum(f["predicted"] == q for f, q in held) >= 0.95 * len(held)
    good, poor = ([f["score"] for f, q in held if q == kind] for kind in (1, 0))
    assert sum((g > p) + 0.5 * (g == p) for g in good for p in poor) >= 0.97 * len(good) * len(poor)
