"""Joins on words, which open few pairs, against all pairs."""

import math
import random

import pytest

from pathloom.operators import ingest, link


def names_of(rng, n, spread):
    """Names of a few words, one of which a third of them have; some nodes have two names, some names two nodes."""
    out = set()
    for i in range(n):
        for _ in range(rng.choice([1, 1, 1, 2])):
            own = [rng.choice(["alpha", f"wa{rng.randrange(spread)}", f"va{rng.randrange(5)}"]) for _ in range(rng.randrange(1, 5))]
            out.add((f"n{i:03}", " ".join(dict.fromkeys(own))))
    return sorted(out)


def fuzzy(questions, names, top):
    words = lambda text: set(text.split())
    df = {}
    for _, name in names:
        for w in words(name):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(1 + len(names) / d) for w, d in df.items()}
    out = set()
    for q, text in questions:
        best = {}
        for i, name in names:
            m = sum(idf[w] for w in words(text) & words(name))
            if m:
                best[i] = max(best.get(i, 0), round(m * m / sum(idf[w] for w in words(name)), 9))
        for rank, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:top], 1):
            out.add((q, i, -s, rank))
    return out


@pytest.mark.parametrize("seed, n, top", [(0, 60, 2), (1, 300, 3), (2, 300, 8)])
def test_fuzzy_names(spark, seed, n, top):
    rng = random.Random(seed)
    names = names_of(rng, n, 12)
    questions = [(f"q{i}", " ".join(rng.choice(["alpha", f"wa{rng.randrange(14)}", f"va{rng.randrange(6)}"]) for _ in range(rng.randrange(1, 6)))) for i in range(25)]
    index = link.name_index(spark.createDataFrame(names, "id string, name string"))
    got = link.fuzzy_candidates(spark.createDataFrame(questions, "q string, question string"), index, link.name_idf(index), top).collect()
    want = fuzzy(questions, names, top)
    assert {(r["q"], r["id"], r["rank"]) for r in got} == {(q, i, rank) for q, i, _, rank in want}
    assert sorted((r["q"], r["rank"], r["score"]) for r in got) == [(q, k, pytest.approx(s)) for q, k, s in sorted((q, k, s) for q, _, s, k in want)]


def test_common_words_open_few_pairs(spark):
    """A third of 3,000 names have a word that every question has too."""
    names = [(f"n{i:05}", f"alpha w{i % 100} u{i}" if i % 3 == 0 else f"w{i % 100} u{i}") for i in range(3000)]
    questions = [(f"q{i}", f"alpha w{i} u{i * 7}") for i in range(50)]
    index = link.name_index(spark.createDataFrame(names, "id string, name string"))
    asked = spark.createDataFrame(questions, "q string, question string")
    pairs = link.fuzzy_pool(asked, index, link.name_idf(index), 8).count()
    assert pairs < 0.1 * sum(bool(set(t.split()) & set(name.split())) for _, t in questions for _, name in names)
    got = {(r["q"], r["id"]) for r in link.fuzzy_candidates(asked, index, link.name_idf(index), 8).collect()}
    assert got == {(q, i) for q, i, _, _ in fuzzy(questions, names, 8)}


def routing(mentions, names, limit, max_df):
    words = lambda text: set(text.split())
    df = {}
    for i, key in names:
        for w in words(key):
            df.setdefault(w, set()).add(i)
    out = set()
    for m, text in mentions:
        known = sorted((w for w in words(text) if w in df), key=lambda w: (len(df[w]), w))
        opening = {w for n, w in enumerate(known) if n == 0 or len(df[w]) <= max_df}
        best = {}
        for i, key in names:
            score = 2.0 if key == text else len(words(text) & words(key)) / len(words(text) | words(key)) if opening & words(key) else 0
            if score:
                best[i] = max(best.get(i, 0), score)
        for rank, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:limit], 1):
            out.add((m, i, -s, rank))
    return out


@pytest.mark.parametrize("seed, max_df", [(0, 3), (1, 20), (2, 0)])
def test_routing(spark, seed, max_df):
    rng = random.Random(seed)
    names = names_of(rng, 250, 12)
    mentions = [(f"m{i}", name if rng.random() < 0.5 else " ".join(dict.fromkeys(rng.choice(["alpha", f"wa{rng.randrange(14)}", f"va{rng.randrange(6)}"]) for _ in range(3)))) for i, (_, name) in enumerate(rng.sample(names, 40))]
    got = ingest.routing_candidates(spark.createDataFrame(mentions, "m string, key string"), spark.createDataFrame(names, "id string, key string"), 4, max_df).collect()
    assert {(r["m"], r["id"], r["score"], r["rank"]) for r in got} == routing(mentions, names, 4, max_df)
