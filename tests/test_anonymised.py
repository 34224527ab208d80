import hashlib
import random
import re

from pathloom.sources.datasets import anonymised_questions

ASKED = "q long, question string, start array<string>"


def alias(name, salt=""):
    return "Entity " + hashlib.sha256(f"{salt}\x1f{name}".encode()).hexdigest()[:6]


def renamed(spark, asked, names, schema="name string", **more):
    out = anonymised_questions(spark.createDataFrame(asked, ASKED), spark.createDataFrame(names, schema), **more)
    return {r["q"]: r for r in out.collect()}


def plain(text, names, least=4):
    """One pattern of all names, the longest first."""
    of = {}
    for n in sorted(names, reverse=True):
        if len(n) >= least:
            of[n.lower()] = n
    pattern = "|".join(map(re.escape, sorted(of, key=len, reverse=True)))
    return re.sub(rf"\b(?:{pattern})\b", lambda m: alias(of[m[0].lower()]), text, flags=re.I)


def test_equals_a_plain_replacement_of_overlapping_names(spark):
    names = ["new york", "New York City", "york city hall", "city", "hall", "St. Louis", "Jean-Luc", "Luc Besson", "o'neil", "Zoë", "Zoë Kravitz", "Ann"]
    draw = random.Random(3)
    words = ["New", "york", "City", "HALL", "of", "St.", "Louis", "Jean-Luc", "Besson", "O'Neil", "zoë", "Kravitz", "Ann", "cityhall", "York-City"]
    asked = [(i, "".join(draw.choice(words) + draw.choice([" ", " ", " ", ", ", "  "]) for _ in range(draw.randint(1, 14))), []) for i in range(300)]
    got = renamed(spark, asked, [(n,) for n in names])
    for q, text, _ in asked:
        assert got[q]["question"] == plain(text, names), text
    assert any(got[q]["question"] != text for q, text, _ in asked)


def test_topics_go_first_and_anywhere(spark):
    asked = [(1, "Who ruled jamaican ports and Jamaica Bay?", ["Jamaica", "Jamaica Bay"]), (2, "Where is it?", ["Rome"]), (3, "a (b) $1 c\\d?", ["(B) $1", "c\\d"])]
    got = renamed(spark, asked, [("Jamaica",), ("ports",)])
    a, bay = alias("Jamaica"), alias("Jamaica Bay")
    assert got[1]["question"] == f"Who ruled {a}n {alias('ports')} and {bay}?" and got[1]["start"] == [a, bay] and got[1]["topic_in_question"]
    assert got[2]["question"] == "Where is it?" and not got[2]["topic_in_question"]
    assert got[3]["question"] == f"a {alias('(B) $1')} {alias(chr(99) + chr(92) + 'd')}?" and got[3]["topic_in_question"]


def test_numbers_records_and_short_names_stay(spark):
    names = [("1999",), ("m.0abc",), ("Bob",), (None,), ("(What",)]
    got = renamed(spark, [(1, "Did Bob see m.0abc (What) in 1999?", ["1999"])], names)
    assert got[1]["question"] == "Did Bob see m.0abc (What) in 1999?" and got[1]["start"] == ["1999"] and got[1]["topic_in_question"]
    assert renamed(spark, [(1, "Did Bob?", [])], [("Bob",)], least=3)[1]["question"] == f"Did {alias('Bob')}?"


def test_each_question_has_its_own_names(spark):
    asked = [(1, "Paris or Texas", []), (2, "Paris or Texas", [])]
    got = renamed(spark, asked, [(1, "Paris"), (2, "Texas")], "q long, name string")
    assert got[1]["question"] == f"{alias('Paris')} or Texas" and got[2]["question"] == f"Paris or {alias('Texas')}"


def test_nulls_repeats_and_nothing(spark):
    asked = [(1, None, ["Rome"]), (2, "", None), (3, "Rome Rome rome", [None])]
    got = renamed(spark, asked, [("Rome",), ("Rome",), ("ROME",)])
    assert got[1]["question"] is None and got[2]["question"] == ""
    assert got[3]["question"] == " ".join([alias("ROME")] * 3)
    assert renamed(spark, asked[2:], [])[3]["question"] == "Rome Rome rome"
    assert renamed(spark, [], [("Rome",)]) == {}
    twice = anonymised_questions(spark.createDataFrame([(7, "Rome", []), (7, "Rome", [])], ASKED), spark.createDataFrame([("Rome",)], "name string"))
    assert [r["question"] for r in twice.collect()] == [alias("Rome")] * 2
