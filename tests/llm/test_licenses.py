"""License scans against a plain search for the phrases."""

import random
import re

from pathloom.llm.licenses import _COMMON, PHRASES, LicenseConfig, best_copies, scan_licenses
from pathloom.llm.notices import NOTICES

TEXTS = [
    "CC BY cc-by cc, by CCBY cc by by",
    "The General Public License, general  public\nlicense. general public",
    "All Rights Reserved. all rights all rights reserved reserved",
    "all rights reserved " * 700,
    "É cc by ü general public licenseé all rıghts reserved",
    NOTICES[0][1].replace("granted", "hereby given").title() + " and so on",
    "Unless required by law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" basis, without warranties or conditions of any kind",
    "of the in the to the and any of this software",
    "license",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for label, phrase in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found}))


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def least_cost(hits, words, k=2):
    """The alignments one by one, each chain extended in all ways."""
    found = [words + 1]

    def extend(p, q, cost):
        found.append(cost + words - q - k)
        for x, y in hits:
            if x > p and y > q:
                extend(x, y, cost + max(x - p - k, y - q - k, 0, abs((x - p) - (y - q))))

    for x, y in hits:
        extend(x, y, y)
    return min(found)


def copies(text, templates, config=LicenseConfig()):
    """Labels and largest share of the templates' copies, by all diagonals of the text."""
    words, found = split(text), []
    for label, template in templates:
        own = split(template)
        grams = {i: own[i : i + 2] for i in range(len(own) - 1) if not set(own[i : i + 2]) <= _COMMON}
        hits = [(p, i) for p in range(len(words) - 1) for i, g in grams.items() if words[p : p + 2] == g]
        votes = {d: sum(p - i == d for p, i in hits) for d in {p - i for p, i in hits}}
        for d, n in votes.items():
            near = {e: m for e, m in votes.items() if abs(e - d) <= config.drift}
            if n == max(near.values()) and not any(m >= n for e, m in near.items() if e < d):
                cost = least_cost([h for h in hits if abs(h[0] - h[1] - d) <= config.drift], len(own))
                if cost == 0:
                    found.append((label, len(own), d))
                assert len(own) < config.short_words
    # copies of different labels compete: the longer first, then the earlier
    kept = []
    for label, n, d in sorted(found, key=lambda c: (-c[1], c[2], c[0])):
        if all(label == other or d >= e + m or e >= d + n for other, m, e in kept):
            kept.append((label, n, d))
    return {label: 1.0 for label, _, _ in kept}


def test_copies_equal_all_alignments(spark):
    rng = random.Random(3)
    templates = [("a", "one two the three four five six of seven"), ("b", "red green blue red green white"), ("c", "licensed under the apache license version 2 0"), ("d", "released under the mit license"), ("e", "seven red green")]
    texts = ["the apache the apache the apache the apache tribes", "released under pressure at the MIT laboratory", "Released under the MIT License.", "", None]
    for _ in range(150):
        words = [rng.choice("x y z the of red".split()) for _ in range(rng.randrange(6))]
        for label, t in rng.sample(templates, 2):
            own = t.split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [rng.choice(["new", own[at], "the"])] * rng.randrange(2)
            words += own + ["x"] * rng.randrange(3)
        texts.append(" ".join(words))
    given = spark.createDataFrame(templates, "label string, text string")
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), templates=given).collect()}
    seen = set()
    for i, text in enumerate(texts):
        want = copies(text, templates)
        assert set(filter(None, got[i]["labels"].split(","))) == set(want), text
        assert abs(got[i]["score"] - max(want.values(), default=0.0)) < 1e-9, text
        seen |= set(want)
    assert seen == {"a", "b", "c", "d", "e"} and got[0]["labels"] == got[1]["labels"] == "" and got[2]["labels"] == "d"


def test_one_copy_among_repeats(spark):
    # a frequent gram makes very many diagonals; the true copy among them is still found, once
    text = "apache license " * 300 + NOTICES[3][1] + " apache license" * 300
    got = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["labels"] == "apache" and got["score"] == 1.0


def test_phrases_equal_a_plain_search(spark, odd_documents, no_documents):
    documents = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in scan_licenses(documents).collect()}
    for i, text in enumerate(TEXTS):
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute(text), text
        assert 0 <= got[i]["score"] <= 1 and set(filter(None, got[i]["base_labels"].split(","))) <= set(got[i]["labels"].split(","))
    assert got[5]["labels"] == "mit" and got[6]["labels"] == "apache" and got[7]["labels"] == "" and got[8]["labels"] == ""
    odd = scan_licenses(odd_documents).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"]) for r in odd) == sorted((r["doc_id"] or -1, brute(r["text"])[0]) for r in odd_documents.collect())
    assert scan_licenses(no_documents).count() == 0


def test_the_right_license(spark):
    """Texts that name one license aren't labelled with another that shares its words."""
    cases = [
        ("Licensed under CC BY 4.0", "cc-by"),
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-nc"),
        ("You may use it under the terms of the GNU General Public License", "gpl"),
        ("under the terms of the GNU Lesser General Public License", "gpl,lgpl"),
        ("This work is licensed under the GNU Affero General Public License version 3", "agpl,gpl"),
        ("released under the MIT laboratory rules", ""),
        ("a photo of the MIT license plate", ""),
        ("Released under the MIT license.", "mit"),
        ("a Creative Commons Zero dedication; this work is licensed under a creative commons zero license", "cc0"),
        (NOTICES[4][1], "gpl,gpl-notice"),
        (NOTICES[4][1].replace("GNU General", "GNU Affero General"), "agpl,gpl"),
        ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gpl,lgpl"),
        (NOTICES[0][1].replace("Software", "Work"), "mit"),
        (NOTICES[1][1] + " " + NOTICES[0][1], "isc,mit"),
        ("All rights reserved.", "reserved"),
    ]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(len(cases))] == [w for _, w in cases]
    assert got[0]["score"] == 0.5 and got[7]["score"] == 1.0 and got[5]["score"] == 0.0 and 0.6 < got[12]["score"] < 1


def test_competing_copies():
    copy = lambda label, share, first, end: {"label": label, "words": end - first, "share": share, "first": first, "end": end}
    assert best_copies([copy("a", 0.7, 0, 50), copy("b", 1.0, 40, 45), copy("c", 0.9, 60, 80)]) == (["b", "c"], 1.0)
    assert best_copies([copy("a", 0.9, 0, 50), copy("b", 0.9, 49, 80), copy("a", 0.8, 45, 49)]) == (["a"], 0.9)  # equal shares: the longer
    assert best_copies([copy("b", 1.0, 5, 25), copy("a", 1.0, 0, 20)]) == (["a"], 1.0)  # equal lengths: the earlier
    assert best_copies([copy("a", 1.0, 0, 50), copy("b", 1.0, 10, 20), copy("c", 0.7, 15, 70)]) == (["a"], 1.0)
    assert best_copies([]) == ([], 0.0)


def test_runs_of_common_words_count(spark):
    templates = [("all", "you are under this in that"), ("run", "red of the in this to green"), ("long", "gold is for you and in the of this or that under the " * 2 + "lead")]
    texts = ["x " + t + " y" for _, t in templates] + ["red of the on this to green", "of the in this to", "you are under this"]
    texts.append(texts[2].replace("gold", "tin"))
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=spark.createDataFrame(templates, "label string, text string")).collect()}
    assert [got[i]["labels"] for i in range(7)] == ["all", "run", "long", "", "", "", "long"]
    assert [got[i]["score"] for i in range(6)] == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0] and 0.8 < got[6]["score"] < 1
