"""Stored replies: broken off anywhere, the next run ends with the same ones and asks for nothing twice."""

import json

import pytest
from pyspark.sql import functions as F

from pathloom.index import Index
from pathloom.sources import replies, snapshot

GOOD = '{"entities": [{"name": "Ada", "type": "person"}], "relations": []}'


class Scripted:
    """Answers with the text's own words; breaks in one of its calls, if told so."""

    def __init__(self, breaks=None):
        self.calls, self.breaks, self.seen = 0, breaks, []

    def __call__(self, asked):
        self.calls += 1
        if self.calls == self.breaks:
            raise RuntimeError("broken off")
        rows = [(r["chunk"], r["text"], r["error"]) for r in asked.collect()]
        self.seen += [(t, e) for _, t, e in rows]
        out = []
        for chunk, text, error in rows:
            if text.startswith("never"):
                reply = "no idea"
            elif text.startswith("later") and error is None:
                reply = '{"entities": 5, "relations": []}'
            else:
                reply = f"Here: {json.dumps({'entities': [{'name': text, 'type': 'x'}], 'relations': []})}"
            out.append((chunk, reply))
        return asked.sparkSession.createDataFrame(out, "chunk string, reply string")


def chunks(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "chunk long, text string")


def rows(frame):
    return sorted(map(tuple, frame.select("chunk", "reply", "attempts", "error").collect()))


TEXTS = [f"text {i}" for i in range(9)] + ["later 1", "later 2", "never 1"]


@pytest.mark.parametrize(
    "reply, error",
    [(GOOD, None), (f"Sure: {GOOD} done", None), ("{}", None), (None, "no reply"), ("", "no object"), ("{", "no object"), ("{x}", "not an extraction"), ('{"entities": 5}', "not an extraction"), ('{"entities": [{"name": "a"}', "not an extraction")],
)
def test_parse_error(spark, reply, error):
    frame = spark.createDataFrame([(reply,)], "reply string")
    assert frame.select(replies.parse_error(F.col("reply"))).first()[0] == error


def test_second_attempts_and_copies(spark, tmp_path):
    script = Scripted()
    got = rows(replies.extracted(chunks(spark, [*TEXTS, "text 0", None, ""]), script, str(tmp_path / "r")))
    assert [(a, e) for _, _, a, e in got] == [(1, None)] * 9 + [(2, None)] * 2 + [(2, "no object")] + [(1, None)] * 3
    assert got[0][1] == got[12][1]
    assert sorted(t for t, e in script.seen if e is None) == sorted([*TEXTS, ""])
    assert sorted((t, e) for t, e in script.seen if e) == [("later 1", "not an extraction"), ("later 2", "not an extraction"), ("never 1", "no object")]


def test_broken_off_anywhere(spark, tmp_path):
    whole = rows(replies.extracted(chunks(spark, TEXTS), Scripted(), str(tmp_path / "whole"), size=4))
    for breaks in (1, 3, 5):
        folder, first, second = str(tmp_path / f"b{breaks}"), Scripted(breaks), Scripted()
        with pytest.raises(RuntimeError):
            replies.extracted(chunks(spark, TEXTS), first, folder, size=4)
        kept = {r["hash"] for r in replies.stored(spark, folder).where("error is null").collect()}
        assert rows(replies.extracted(chunks(spark, TEXTS), second, folder, size=4)) == whole
        assert len({t for t, _ in second.seen}) == len(TEXTS) - len(kept)


def test_bounded_calls_and_versions(spark, tmp_path):
    folder = str(tmp_path / "r")
    part = rows(replies.extracted(chunks(spark, TEXTS), Scripted(), folder, size=4, windows=1))
    asked = [r for r in part if r[3] != replies.NOT_ASKED]
    assert 0 < len(asked) < len(part) and len(snapshot.versions(spark, folder)) == 1
    rest = Scripted()
    assert len(rows(replies.extracted(chunks(spark, TEXTS), rest, folder))) == len(TEXTS)
    again = Scripted()
    replies.extracted(chunks(spark, TEXTS), again, folder)
    assert {t for t, _ in again.seen} == {"never 1"}
    other = Scripted()
    replies.extracted(chunks(spark, TEXTS), other, folder, version="2")
    assert {t for t, _ in other.seen} == set(TEXTS)


def test_nothing_to_ask(spark, tmp_path):
    assert rows(replies.extracted(chunks(spark, []), Scripted(1), str(tmp_path / "r"))) == []


def test_incomplete_documents_are_tried_again(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    texts = spark.createDataFrame([("a", "a", "Ada wrote."), ("b", "b", "never said")], "key string, title string, text string")
    index.ingest(texts, Scripted())
    assert [r["key"] for r in index.incomplete().collect()] == ["b"]
    assert {r["name"] for r in index.frames["nodes"].collect()} == {"Ada wrote."}

    class Better(Scripted):
        def __call__(self, asked):
            self.seen += [r["text"] for r in asked.collect()]
            return asked.select("chunk", F.lit(GOOD).alias("reply"))

    better = Better()
    states = {r["key"]: r["state"] for r in index.ingest(texts, better).collect()}
    assert states == {"a": "unchanged", "b": "changed"} and better.seen == ["never said"]
    assert index.incomplete().count() == 0
    assert {r["name"] for r in index.frames["nodes"].collect()} == {"Ada wrote.", "Ada"}
