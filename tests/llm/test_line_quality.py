"""Quality measures against plain Python, decoding against all label sequences."""

import itertools
import random
import re
from collections import Counter

import numpy as np

from pathloom.llm.line_quality import LineModel, _judge, _measure, QualityConfig, fit_line_model, keep_quality, line_quality, viterbi

from .conftest import ODD_TEXTS


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), failed


def test_measures_equal_plain_python(spark, odd_documents, no_documents):
    rng = random.Random(3)
    texts = ODD_TEXTS + ["".join(rng.choice(["a ", "b", "\n", "c# ", "é", "\t", "\x0b", "\n\n"]) for _ in range(rng.randrange(400))) for _ in range(150)]
    got = {r["doc_id"]: r for r in line_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), LineModel()).collect()}
    for i, text in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute(text), text
        assert not (got[i]["kept"] and got[i]["base_failed"]) and got[i]["n_lines"] == len((text or "").split("\n"))
    assert line_quality(odd_documents, LineModel()).count() == odd_documents.count()
    assert keep_quality(odd_documents, LineModel()).columns == odd_documents.columns
    assert line_quality(no_documents, LineModel()).count() == keep_quality(no_documents, LineModel()).count() == 0


def test_decoding_is_the_best_sequence():
    rng = np.random.default_rng(0)
    model = LineModel(start=(0.3, -0.2), moves=((0.5, -1.0), (-0.4, 0.8)))
    lengths = [0, 1, 5, 3, 7, 1]
    bounds = np.append(0, np.cumsum(lengths))
    scores = rng.normal(0, 1, (bounds[-1], 2))
    labels = viterbi(scores, bounds, model)
    for a, b in zip(bounds, bounds[1:]):
        value = lambda y: sum(scores[a + t, s] for t, s in enumerate(y)) + (model.start[y[0]] if y else 0) + sum(model.moves[s][t] for s, t in zip(y, y[1:]))
        assert tuple(labels[a:b]) == max(itertools.product((0, 1), repeat=b - a), key=value)


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(240):
        good = i % 2
        words = ["".join(rng.choice("aeionrst") for _ in range(rng.randrange(2, 9))) for _ in range(80)]
        if not good:
            words = [w + "$$%" for w in words] if i % 4 else [w.upper() + "!!" for w in words]
        rows.append((i, "\n".join(" ".join(words[j : j + 10]) + ("." if good else "") for j in range(0, 80, 10))))
        labels.append((i, good, 0))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit_line_model(documents, spark.createDataFrame(labels[:120], "doc_id long, quality int, toxic int"), QualityConfig(fit_steps=60))
    right = [r["kept"] == bool(r["doc_id"] % 2) for r in line_quality(documents, model).collect() if r["doc_id"] >= 120]
    assert sum(right) >= 0.97 * len(right)
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert fit_line_model(documents, none) == LineModel()


def mixed(rng, good):
    """Lines of both kinds in one document: (text, its content lines)."""
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randrange(2, 9)))
    n = 16
    content = round(n * (rng.uniform(0.6, 0.9) if good else rng.uniform(0.1, 0.4)))
    first = rng.randrange(n - content + 1)  # one run of content, as menus and footers surround it
    lines = []
    for i in range(n):
        words = [word() for _ in range(8)]
        lines.append(" ".join(words) + "." if first <= i < first + content else " ".join(w.upper() + "!!" for w in words))
    return "\n".join(lines), content


def test_lines_of_mixed_documents_are_told_apart(spark):
    rng = random.Random(11)
    made = [mixed(rng, i % 2) for i in range(160)]
    documents = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in line_quality(documents, fit_line_model(documents, labels, QualityConfig(fit_steps=80))).collect()}
    held_out = range(80, 160)
    assert sum(got[i]["n_content_lines"] == made[i][1] for i in held_out) >= 0.9 * len(held_out)
    assert sum(got[i]["kept"] == bool(i % 2) for i in held_out) >= 0.97 * len(held_out)
    assert sum(0 < got[i]["content_share"] < 1 for i in held_out) >= 0.9 * len(held_out)


def test_verdicts_equal_all_label_sequences():
    rng = random.Random(13)
    model = LineModel(start=(0.2, -0.3), moves=((0.6, -0.8), (-0.5, 0.9)))
    for _ in range(60):
        text = "\n".join(" ".join(rng.choice(["plain", "words", "###", "$$$", "LOUD", "9 9"]) for _ in range(rng.randrange(12, 20))) for _ in range(rng.randrange(1, 8)))
        data, rows = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
        counts, features, _, words = _measure(data, rows, 3)
        scores = features @ np.array(model.weights)
        value = lambda y: sum(s * l for s, l in zip(scores, y)) + model.start[y[0]] + sum(model.moves[a][b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(words)), key=value)
        share = sum(int(w) for w, l in zip(words, best) if not l) / max(int(counts["n_words"][0]), 1)
        verdict = _judge(data, rows, QualityConfig(), model)
        assert abs(verdict["content_share"][0] - share) < 1e-12
        assert bool(verdict["kept"][0]) == (not brute(text)[5] and share >= 0.5)
