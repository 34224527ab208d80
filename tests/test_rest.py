"""Readers, linking, retrieval, ingestion, metrics and streams on small inputs."""

import inspect
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import text as X
from pathloom.operators import ingest, link, locate, metrics
from pathloom.operators.graph import Graph
from pathloom.sources import datasets, documents, snapshot, triples
from pathloom.streaming.ingest import ingest_stream


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_triple_files(spark, tmp_path):
    csv = write(tmp_path / "a.csv", "head,predicate,tail,subject_type,object_name\nx,likes,y,person,Why\nonly,two\n\n")
    rows, skipped = triples.read_triples(spark, csv)
    assert [(r["subject"], r["relation"], r["object"], r["subject_type"], r["object_name"]) for r in rows.collect()] == [("x", "likes", "y", "person", "Why")]
    assert skipped.first()["skipped"] == 1
    pipe = write(tmp_path / "b.txt", "a|r|b\na|r|\nb|s|c\n")
    rows, skipped = triples.read_triples(spark, pipe)
    assert rows.count() == 2 and skipped.first()["skipped"] == 1
    jsonl = write(tmp_path / "c.jsonl", '{"subject": "a", "rel": "r", "object": "b"}\n[1]\nnot json\n{"subject": null, "head": "h", "rel": "r", "to": "x"}\n')
    rows, skipped = triples.read_triples(spark, jsonl)
    assert rows.count() == 1 and skipped.first()["skipped"] == 3
    nt = write(
        tmp_path / "d.nt",
        '# comment\n<http://e.org/A> <http://www.w3.org/2000/01/rdf-schema#label> "Aleph" .\n<http://e.org/A> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e.org/Thing> .\n'
        '<http://e.org/A> <http://e.org/knows> _:b1 .\n<http://e.org/A> <http://e.org/said> "say \\"hi\\"\\u00e9"@en .\nbad line\n',
    )
    rows, skipped = triples.read_triples(spark, nt)
    got = {r["relation"]: r for r in rows.collect()}
    assert skipped.first()["skipped"] == 1 and set(got) == {"knows", "said"}
    assert got["said"]["object_name"] == 'say "hi"é' and re.fullmatch("lit:[0-9a-f]{24}", got["said"]["object"]) and got["said"]["object_type"] == "literal"
    assert got["knows"]["subject_name"] == "Aleph" and got["knows"]["subject_type"] == "Thing"
    with pytest.raises(triples.TripleFormatError):
        triples.detect_format("x.parquet")


def test_headers_are_read_in_each_file(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    write(tmp_path / "csv" / "b.csv", "head,predicate,tail\na,r,b\n")
    write(tmp_path / "csv" / "a.csv", 'tail,note,Relation,Head\n"x\ny",n,r,z\n,,,\nbad,,,\n')
    write(tmp_path / "csv" / "c.csv", "one,two,three\n")
    for multi in (True, False):
        rows, skipped = triples.read_delimited(spark, str(tmp_path / "csv"), multi_line=multi)
        got = [tuple(r) for r in rows.orderBy("ord").select("subject", "relation", "object").collect()]
        assert got[-2:] == [("a", "r", "b"), ("one", "two", "three")]
        if multi:
            assert got[0] == ("z", "r", "x\ny") and len(got) == 3 and skipped.first()["skipped"] == 1


def test_escapes():
    cases = {r"a\tb\\n\q": "a\tb\\nq", r"\u00e9\U0001F600\u12": "é😀u12", "\\\\\\\\t": "\\\\t", "end\\": "end\\", r"\UFFFFFFFF": "UFFFFFFFF", "plain": "plain"}
    assert {k: triples._plain(k) for k in cases} == cases


def test_ntriples_are_split_over_tasks(spark, tmp_path):
    label = "<http://www.w3.org/2000/01/rdf-schema#label>"
    (tmp_path / "nt").mkdir()
    lines = {"b.nt": [], "a.nt": []}
    for i in range(3000):
        lines["a.nt" if i < 500 else "b.nt"] += [f'<http://e.org/s{i % 700}> {label} "name {i}" .', f"<http://e.org/s{i % 700}> <http://e.org/r> <http://e.org/o{i}> ."] + ["", "# note"] * (i % 2)
    for name, own in lines.items():
        write(tmp_path / "nt" / name, "\n".join(own) + ("\r\n" if name == "a.nt" else ""))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert triples._numbered_lines(spark, str(tmp_path / "nt")).rdd.getNumPartitions() > 5
        got = sorted(triples._numbered_lines(spark, str(tmp_path / "nt")).collect())
        rows, skipped = triples.read_ntriples(spark, str(tmp_path / "nt"))
        found = {r["object"]: (r["subject"], r["subject_name"]) for r in rows.collect()}
        assert skipped.first()["skipped"] == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [r["line"].rstrip("\r") for r in got] == lines["a.nt"] + lines["b.nt"] and [r["ord"] for r in got] == list(range(len(got)))
    assert found == {f"http://e.org/o{i}": (f"http://e.org/s{i % 700}", f"name {i % 700}") for i in range(3000)}


def test_import_keeps_nodes(spark, tmp_path):
    rows, _ = triples.read_triples(spark, write(tmp_path / "a.csv", "s,p,o,subject_name\nx,r,y,New\nx,r,y,Other\nz,r,x,\n"))
    old = spark.createDataFrame([("x", "person", "Old")], "id string, type string, name string")
    nodes, edges, report = triples.import_triples(old, spark.createDataFrame([], "source string, type string, target string"), rows)
    assert {(r["id"], r["type"], r["name"]) for r in nodes.collect()} == {("x", "person", "Old"), ("y", "entity", "y"), ("z", "entity", "z")}
    assert tuple(report.first()) == (2, 2)
    again = triples.import_triples(nodes, edges.drop("id"), rows)
    assert tuple(again[2].first()) == (0, 2) and again[1].count() == 2


def test_document_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "note.md", "# Hello")
    write(tmp_path / "r.jsonl", '{"id": "1", "text": "one", "title": "T"}\n{"id": "1", "body": "two"}\n{"id": "3", "year": "1999"}\n')
    write(tmp_path / "l.json", '[{"id": "a", "content": "listed"}]')
    got = {r["doc_id"]: r["text"] for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["sub/note.md"] == "# Hello" and got["r.jsonl#1"] == "one" and got["r.jsonl#1@1"] == "two" and got["l.json#a"] == "listed"
    assert "year: 1999" in got["r.jsonl#3"]
    with pytest.raises(ValueError):
        documents.read_one(spark, str(tmp_path), "../x")
    with pytest.raises(ValueError):
        documents.in_memory(spark, [("a", "x"), ("a", "y")])


def test_snapshots(spark, tmp_path):
    g = Graph(spark.createDataFrame([("a", "t", "A")], "id string, type string, name string"), spark.createDataFrame([("a", "r", "a")], "source string, type string, target string"))
    snapshot.migrate(g, str(tmp_path / "g"))
    loaded, meta = snapshot.load(spark, str(tmp_path / "g"))
    assert loaded.counts().first() == g.counts().first() and meta.count() == 0
    with pytest.raises(FileExistsError):
        snapshot.save(g, str(tmp_path / "g"))
    first = snapshot.set_metadata(meta, spark.createDataFrame([("k", "1"), ("l", "2")], "key string, value_json string"))
    second = snapshot.set_metadata(first, spark.createDataFrame([("k", None), ("l", "3")], "key string, value_json string"))
    assert [tuple(r) for r in second.collect()] == [("l", "3")]


def test_linking(spark):
    names = spark.createDataFrame([("bar", "Prince Bar"), ("reg", "Prince Reginald"), ("reg3", "Prince Reginald the Third"), ("w", "Who")], "id string, name string")
    asked = spark.createDataFrame([("q", "Who married Prince Bar or Reginald?")], "q string, question string")
    index = link.name_index(names)
    assert [(r["id"], r["pos"]) for r in link.exact_mentions(asked, index).collect()] == [("bar", 2)]
    fuzzy = [r["id"] for r in link.fuzzy_candidates(asked, index, link.name_idf(index)).orderBy("rank").collect()]
    assert fuzzy[0] == "bar" and fuzzy.index("reg") < fuzzy.index("reg3")


def test_chunks_are_exact(spark):
    rng = random.Random(1)
    for seed in range(200):
        text = "".join(rng.choice(["word ", "x. ", "\n\n", "long" * 9, "! ", "\n \n"]) for _ in range(rng.randrange(60)))
        limit = rng.choice([5, 20, 100, 2000])
        for spans in locate.chunk_spans(text, limit):
            assert sum(b - a for a, b in spans) + 2 * (len(spans) - 1) <= limit
            assert all(a < b and b - a <= limit for a, b in spans)
        flat = [s for spans in locate.chunk_spans(text, limit) for s in spans]
        assert flat == sorted(flat) and all(b <= c for (_, b), (c, _) in zip(flat, flat[1:]))
        assert "".join("".join(text[a:b] for a, b in flat).split()) == "".join(text.split())
    frame = spark.createDataFrame([("d", "First one.\n\nSecond one.")], "key string, text string")
    chunk = locate.chunked(frame, 100).withColumn("s", locate.chunk_to_document(F.col("pieces"), F.lit(12), F.lit(18))).first()
    assert chunk["text"][12:18] == "Second" and "First one.\n\nSecond one."[chunk["s"]["start"] : chunk["s"]["end"]] == "Second"


@pytest.mark.parametrize("quote, want", [("was born in Paris", (10, 27)), ("WAS  born in\nparis", (10, 27)), ("“was born in Paris…”", (10, 27)), ("xy", None), ("nowhere at all", None)])
def test_evidence(quote, want):
    assert locate.folded_evidence("Marie who was born in Paris in 1900", quote) == want


def test_quote_pairs_lose_nothing(spark):
    quotes = ["The quick brown fox jumped over it", "“The quick brown fox…”", "quick brown fox", "brown fox", "foxes", "a    b", "Straße nach Kassel hin gebaut", "ΟΔΥΣΣΕΥΣ went home to Ithaca", "cat sat", "  one two three four five six ", "none of these are anywhere at all", "''", "", "xy", None]
    base = " ".join(q for q in quotes if q)
    words = ["The", "quick", "brown", "fox", "foxes", "a", "b", "cat", "sat", "one"]
    rng = random.Random(4)
    texts = [base, base.upper(), base.lower(), base.replace(" ", "\n"), re.sub(r"\s+", " \t\u00a0\x1c", base.title()), "He said:the QUICK\r\nbrown  foxy things", "overQuick", "bra\ncatSAT\u2003SATurn", "xone two\nTHREE four five sixty", "οδυσσευς", "Οδυσσευς WENT home\nto ithaca", "\u017ftra\u00dfe", None, ""]
    texts += [rng.choice([" ", "\n", "  "]).join(rng.choice([str.lower, str.upper, str])(rng.choice(words)) for _ in range(12)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "key int, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(quotes)), "item int, quote string")
    pairs = {tuple(r) for r in locate.quote_pairs(docs, asked.select("item", locate.bare_quote("quote").alias("quote"))).collect()}
    want = {(d, i) for d, t in enumerate(texts) for i, q in enumerate(quotes) if locate.folded_evidence(t or "", q)}
    assert want <= pairs and len({i for _, i in want}) >= 10 and len(pairs) < len(texts) * len(quotes)
    exact = {tuple(r) for r in locate.quote_pairs(docs, asked).collect()}
    assert {(d, i) for d, t in enumerate(texts) for i, q in enumerate(quotes) if t and q and q in t} <= exact


def test_characters_that_differ_by_case():
    source, target = locate._case_pairs()
    one = str.maketrans(source, target)
    for c in map(chr, range(0x3000)):
        for other in {c.lower(), c.upper(), c.swapcase(), c.casefold(), c.upper().lower()}:
            if len(other) == 1 and re.fullmatch(re.escape(c), other, re.I):
                assert c.translate(one) == other.translate(one)


def test_passages_recased_and_rewrapped(spark, tmp_path):
    from pathloom.plans import catalogue

    passages = ["Alpha beta gamma delta epsilon zeta", "Short passage here", "two words", "five words are\nin this"]
    texts = [p for q in passages for p in (q, "x " + q.upper() + ".", "y\n" + q.replace(" ", "\n  ").title() + " z", "no " + q[:3])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folded = catalogue.queries()["find_evidence_folded"](spark, str(tmp_path)).where("start is not null").collect()
    want = {(d, i, *s) for d, t in enumerate(texts) for i, q in enumerate(passages) if (s := locate.folded_evidence(t, q))}
    assert {(r["doc_id"], r["item_id"], r["start"], r["end"]) for r in folded} == want and len(want) == 12
    exact = catalogue.queries()["evidence_exact"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["item_id"], r["start"]) for r in exact} == {(d, i, t.index(q)) for d, t in enumerate(texts) for i, q in enumerate(passages) if q in t}


def test_fusion_and_selection(spark):
    rows = [("q", 0, 0, "d", 0, 10), ("q", 0, 1, "d", 20, 30), ("q", 1, 0, "d", 5, 12), ("q", 1, 1, "e", 0, 3)]
    fused = locate.fuse_spans(spark.createDataFrame(rows, "q string, list int, rank int, key string, start int, end int"), 3).orderBy("rank").collect()
    assert (fused[0]["start"], round(fused[0]["score"], 9)) == (0, round(2 / 61, 9)) and len(fused) == 3
    taken = locate.select_spans(spark.createDataFrame([r[:1] + r[2:] for r in rows[:2]] + [("q", 2, "d", 25, 40)], "q string, rank int, key string, start int, end int"), 5)
    assert taken.count() == 2


def test_extractions(spark):
    reply = "Sure: " + json.dumps({"entities": [{"name": "Marie Curie", "type": "Person"}, {"name": "marie  curie", "type": "x"}, {"name": "Paris", "type": "City"}], "relations": [{"source": "Marie Curie", "type": "Lived In", "target": "Paris"}, {"source": "Paris", "type": "is", "target": "paris"}, {"source": "Paris", "type": "in", "target": "France"}]})
    mentions, facts = ingest.clean_extractions(ingest.parse_extractions(spark.createDataFrame([("c", reply), ("d", "no json")], "chunk string, reply string")))
    assert {(r["key"], r["type"]) for r in mentions.collect()} == {("marie curie", "person"), ("paris", "city")}
    assert [(r["source"], r["type"], r["target"]) for r in facts.collect()] == [("marie curie", "lived_in", "paris")]
    assert len(ingest.SCHEMA_RELATIONS) == 38


def test_routing_opens_the_rarest_common_word(spark):
    rows = [("n%03d" % i, f"common {i % 3} part") for i in range(300)] + [("r%03d" % i, f"common rare{i % 40}") for i in range(250)] + [("n299", "common 7"), ("x1", "rarely seen"), ("x2", "seen thing")]
    asked = [("all", "common part"), ("unknown", "common nowhere"), ("exact", "common 1 part"), ("rare", "common seen"), ("none", "absent")]
    names = spark.createDataFrame(rows, "id string, key string")
    got = ingest.routing_candidates(spark.createDataFrame(asked, "m string, key string"), names).orderBy("m", "rank").collect()
    ids = {}
    for i, key in rows:
        for w in set(key.split()):
            ids.setdefault(w, set()).add(i)
    want = []
    for m, mkey in sorted(asked):
        own = set(mkey.split())
        known = sorted((len(ids[w]), w) for w in own if w in ids)
        opening = {w for n, w in known if n <= 200} or {w for _, w in known[:1]}
        best = {}
        for i, key in rows:
            w = set(key.split())
            score = 2.0 if key == mkey else len(own & w) / len(own | w) if opening & w else 0
            if score:
                best[i] = max(score, best.get(i, 0))
        want += [(m, i, round(s, 9), n) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:8], 1)]
    assert [(r["m"], r["id"], round(r["score"], 9), r["rank"]) for r in got] == want
    assert {m for m, *_ in want} == {"all", "unknown", "exact", "rare"}


def test_answers_and_metrics(spark):
    norm = lambda s: spark.range(1).select(X.normalize_answer(F.lit(s)).alias("x")).first()["x"]
    assert norm("The  Dark Knight!") == "dark knight" and norm("An apple, a day") == "apple day"
    got = metrics.set_scores(spark.createDataFrame([("s", 1, ["X", "Y", "Z"], ["x", "y"])], "system string, question_id int, predicted array<string>, gold array<string>")).first()
    assert (round(got["precision"], 6), got["recall"], round(got["f1"], 6), got["em"], got["hits"]) == (0.666667, 1.0, 0.8, 0.0, 1.0)
    pairs = spark.createDataFrame([(1, "Missoula", "Missoula, Montana"), (2, "the", "a"), (3, "x", "y")], "id int, predicted string, gold string")
    assert {r["id"]: round(r["f1"], 6) for r in metrics.token_f1(pairs).collect()} == {1: 0.666667, 2: 1.0, 3: 0.0}
    values = spark.createDataFrame([(1, float(x)) for x in (3, 1, 2, 4)], "g int, v double")
    assert metrics.nearest_rank(values, ["g"], "v", 50).first()["value"] == 2 and metrics.nearest_rank(values, ["g"], "v", 95).first()["value"] == 4
    rows = [("one", 1, 1.0, 1.0), ("one", 2, 0.0, 0.0), ("tie", 1, 0.5, 1.0), ("tie", 2, 0.5, 0.0), ("bad", 1, 0.9, 0.0)]
    scores = spark.createDataFrame(rows, "system string, question_id int, confidence double, em double")
    assert {r["system"]: r["ece"] for r in metrics.ece(scores).collect()} == {"one": 0.0, "tie": 0.0, "bad": 0.9}
    assert {r["system"]: r["auroc"] for r in metrics.auroc(scores).collect()} == {"one": 1.0, "tie": 0.5, "bad": None}


def test_intervals_and_curves(spark):
    assert metrics.bootstrap_mean([0.5] * 9) == (0.5, 0.5) and all(map(math.isnan, metrics.bootstrap_mean([])))
    rng = np.random.default_rng(0)
    values = spark.createDataFrame([("a", float(v)) for v in rng.normal(2, 1, 400)], "g string, v double")
    low, high = metrics.bootstrap_ci(values, ["g"], "v").select("low", "high").first()
    assert low < 2.1 and high > 1.9 and 0.1 < high - low < 0.35
    x = rng.normal(0, 1, 3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(1.5 * x - 0.5)))).astype(float)
    a, b = metrics.platt_fit(x, y)
    assert abs(a - 1.5) < 0.2 and abs(b + 0.5) < 0.2


def test_interval_has_2000_resamples(spark):
    values = [float(v) for v in np.random.default_rng(1).integers(0, 5, 500)]
    frame = spark.createDataFrame([("a", v) for v in values], "g string, v double").repartition(3)
    spread = []
    for seed in range(6):
        low, high = metrics.bootstrap_ci(frame, ["g"], "v", seed=seed).select("low", "high").first()
        spread.append((low, high))
    half = 1.96 * np.std(values) / math.sqrt(len(values))
    assert np.allclose(np.mean(spread, 0), [np.mean(values) - half, np.mean(values) + half], atol=0.1 * half)
    assert inspect.signature(metrics.bootstrap_ci).parameters["resamples"].default == inspect.signature(metrics.bootstrap_mean).parameters["resamples"].default == 2000


def test_names_and_values(spark):
    assert X.plain_name("Café Müller (film)") == "cafe muller" and X.plain_name("Łódź Straße Æon") == "lodz strasse aeon"
    dates = ["4 July 1776", "July 4, 1776", "July 4 1776", "1776-07-04", "4 Jul 1776", "Jul 4, 1776", " 04 july 1776 "]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*dates, "1776/07/04", "31 June 1776", "Café (film)", None])], "i int, v string")
    got = [r[0] for r in rows.orderBy("i").select(X.norm_value(F.col("v"))).collect()]
    assert got == ["1776-07-04"] * 7 + ["1776 07 04", "31 june 1776", "cafe", None]


def test_question_sets(spark, tmp_path):
    kb = datasets.bar_triples(spark, write(tmp_path / "kb.txt", "a|r|b\na|r|b\nbad|line\nb|r|c\n"))
    assert kb.count() == 2
    asked = datasets.bracket_questions(spark, write(tmp_path / "qa.txt", "who made [Brazil]\tx|y\n")).first()
    assert (asked["question"], asked["topic"], asked["answers"]) == ("who made Brazil", "Brazil", ["x", "y"])
    rows = spark.createDataFrame([("q1", "?", ["Kingston"], ["Jamaica", "Absent"], [["Jamaica", "capital", "m.0nf"], ["m.0nf", "name", "Kingston"]])], "id string, question string, answer array<string>, q_entity array<string>, graph array<array<string>>")
    own, questions = datasets.subgraph_questions(rows)
    assert own.count() == 2 and questions.first()["start"] == ["Jamaica"]
    assert {r["object_type"] for r in datasets.typed(own).collect()} == {"record", "entity"}
    hidden, aliases = datasets.anonymised(datasets.union_graph(own))
    assert {r["alias"] for r in aliases.where("name like 'm.%'").collect()} == {"m.0nf"} and hidden.count() == 2


def test_stream_hands_on_what_changed(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    run = lambda: ingest_stream(spark.readStream.schema("key string, text string").json(str(source)), str(tmp_path / "ledger"), str(tmp_path / "check"), lambda rows, n: seen.append(sorted(map(tuple, rows.collect())))).awaitTermination()
    write(source / "1.json", '{"key": "a", "text": "one"}\n{"key": "b", "text": "two"}\n')
    run()
    write(source / "2.json", '{"key": "a", "text": "one"}\n{"key": "b", "text": "new"}\n')
    run()
    assert seen == [[("a", "one"), ("b", "two")], [("b", "new")]]
