"""Walk rules and budgets, written paths, graph spans, nested evidence, saved vectors."""

import json
import math

import pytest
from pyspark.sql import functions as F

from pathloom.operators import evaluate, link, locate, metrics, walk
from pathloom.operators.decide import STOP, FunctionDecider, LexicalDecider, TableDecider
from pathloom.operators.graph import Graph, ordered_union
from pathloom.operators.lineage import numbered
from pathloom.sources import datasets


@pytest.fixture(scope="module")
def trap(spark):
    """One step leads to B or C, the second from either to D, from B also to E."""
    nodes = spark.createDataFrame([(n, "goal" if n in "DE" else "way", n) for n in "ABCDE"], "id string, type string, name string")
    edges = spark.createDataFrame([("A", "r", "B"), ("A", "r", "C"), ("B", "r", "D"), ("B", "r", "E"), ("C", "r", "D")], "source string, type string, target string")
    table = [("A", "B", 0.55), ("A", "C", 0.45), ("B", "D", 0.3), ("B", "E", 0.3), ("B", STOP, 0.4), ("C", STOP, 0.99), ("C", "D", 0.01)]
    decider = TableDecider(spark.createDataFrame(table, "cur string, opt string, w double"))
    starts = spark.createDataFrame([("q", "where to", "A", 0)], "q string, question string, node string, ord int")
    return Graph(nodes, edges), starts, decider


def answers(frame):
    return {tuple(r["frontier"]): r for r in frame.collect()}


def test_beam_beats_greedy_and_the_gate_moves_on(spark, trap):
    graph, starts, decider = trap
    config = walk.WalkConfig(unit="entity", width=3, max_depth=2, stop_at_start=False, directions="out")
    found = answers(walk.walk(graph, starts, decider, config))
    best = min(found.values(), key=lambda r: r["rank"])
    assert best["frontier"] == ["C"] and abs(best["score"] - (math.log(0.45) + math.log(0.99)) / 2) < 1e-9
    # the answers' type is asked for first; STOP isn't offered on nodes of another type
    typed = TableDecider(decider.decisions.union(spark.createDataFrame([("type", "goal", 0.9), ("type", "way", 0.1)], decider.decisions.schema)))
    gated = answers(walk.walk(graph, starts, typed, walk.WalkConfig(unit="entity", max_depth=2, stop_at_start=False, directions="out", gate=0.6), types=graph.nodes.select("type")))
    assert gated and all(set(f) <= {"D", "E"} for f in gated)
    assert walk.answer_types(typed, starts, graph.nodes.where("type = 'way'").select("type")).count() == 0


def test_budgets_end_walks_with_what_they_have(trap):
    graph, starts, decider = trap
    base = {"unit": "entity", "width": 3, "max_depth": 3, "stop_at_start": False, "directions": "out"}
    one = answers(walk.walk(graph, starts, decider, walk.WalkConfig(**base, max_calls=1)))
    assert set(one) == {("B",), ("C",)} and {r["finished"] for r in one.values()} == {"aborted"}
    none = answers(walk.walk(graph, starts, decider, walk.WalkConfig(**base, max_calls=0)))
    assert set(none) == {("A",)} and none["A",]["finished"] == "aborted"
    # the second depth asks once for each of two beams
    per_beam = answers(walk.walk(graph, starts, decider, walk.WalkConfig(**base, max_calls=2, per_beam=True)))
    assert {r["finished"] for r in per_beam.values()} == {"aborted"}
    tokens = answers(walk.walk(graph, starts, decider, walk.WalkConfig(**base, max_tokens=5)))
    assert set(tokens) == {("B",), ("C",)}
    free = answers(walk.walk(graph, starts, decider, walk.WalkConfig(**base, max_calls=9, max_tokens=900)))
    assert "aborted" not in {r["finished"] for r in free.values()}


def test_labels_shuffles_and_caps(spark, trap):
    graph, starts, _ = trap
    seen = spark.sparkContext.accumulator(0)

    def by_label(pdf):
        seen.add(int(pdf["label"].str.fullmatch(r"o[0-9]+|STOP").all()))
        return (pdf["key"] == "B").astype(float) + 0.1

    config = walk.WalkConfig(unit="entity", width=1, max_depth=1, stop_at_start=False, directions="out", labels="opaque", shuffle="s")
    assert set(answers(walk.walk(graph, starts, FunctionDecider(by_label), config))) == {("B",)} and seen.value >= 1
    hub = Graph(spark.createDataFrame([(f"n{i}", "t", f"name {i}") for i in range(40)], "id string, type string, name string"), spark.createDataFrame([("n0", "r", f"n{i}") for i in range(1, 40)], "source string, type string, target string"))
    asked = spark.createDataFrame([("q", "which is name 17", "n0", 0)], "q string, question string, node string, ord int")
    few = walk.walk(hub, asked, LexicalDecider(), walk.WalkConfig(unit="entity", width=50, max_depth=1, stop_at_start=False, similar_above=10, similar_top=5))
    assert few.count() == 5 and ("n17",) in answers(few)


def test_written_paths_and_retries(spark, trap):
    graph, _, _ = trap
    hop = {"relation": "r", "direction": "out"}
    replies = [(1, json.dumps({"path": [hop, hop]})), (2, "{}"), (3, json.dumps({"path": []})), (4, json.dumps({"path": [hop] * 5})), (5, json.dumps({"path": [{"relation": "r"}]})), (6, None)]
    read = evaluate.parsed_paths(spark.createDataFrame(replies, "q int, reply string"), graph.schema())
    assert dict(read.select("q", "problem").collect()) == {1: None, 2: "no path", 3: "empty path", 4: "more than 4 hops", 5: "unknown direction (none)", 6: "no path"}
    good, bad = evaluate.retry(read.withColumn("attempt", F.lit(1)))
    assert bad.count() == 5
    starts = spark.createDataFrame([(1, "A"), (9, "A")], "q int, node string")
    assert sorted(map(tuple, evaluate.run_paths(graph, good, starts).collect())) == [(1, "D"), (1, "E")]


def test_graph_spans_come_in_order_without_overlaps(spark):
    walked = spark.createDataFrame([("q", 1, 0, "e1"), ("q", 1, 1, "e2")], "q string, answer int, hop int, edge string")
    nodes = spark.createDataFrame([("q", 1, "n1")], "q string, answer int, node string")
    entries = spark.createDataFrame([("q", 1, "n2")], "q string, ord int, node string")
    proofs = [("e2", "d", 50, 60, 1.0), ("e1", "d", 0, 10, 0.5), ("n1", "d", 5, 8, 1.0), ("n1", "f", 0, 4, 0.9), ("n2", "g", 1, 2, 1.0)]
    provenance = spark.createDataFrame(proofs, "element string, key string, start int, end int, confidence double")
    got = locate.graph_spans(walked, nodes, entries, provenance, 10).orderBy("rank").select("key", "start").collect()
    assert [tuple(r) for r in got] == [("d", 0), ("d", 50), ("f", 0), ("g", 1)]


def test_nested_evidence_and_saved_vectors(spark, tmp_path):
    tree = [{"evidence": {"pageid": 1, "revid": 2, "title": "One"}, "decomposition": [{"evidence": {"pageid": 3, "revid": 1, "title": "Three"}, "decomposition": []}]}, {"evidence": {"pageid": "###", "revid": 0, "title": "?"}}, {"evidence": {"pageid": 1, "revid": 2, "title": "One"}}, {"evidence": {"pageid": 2, "revid": 2, "title": "Two"}}]
    pages = datasets.fanout_pages(spark.createDataFrame([("q", json.dumps(tree))], "id string, decomposition string"))
    assert [tuple(r) for r in pages.orderBy("place").select("page", "title").collect()] == [("1", "One"), ("3", "Three"), ("2", "Two")]
    corpus = spark.createDataFrame([("3", "Three", "text of three")], "page string, title string, text string")
    assert datasets.fanout_contexts(pages, corpus, 4).first()["text"] == "text"
    chunks = spark.createDataFrame([("a", 0, "red apples"), ("b", 0, "blue whales")], "key string, chunk int, text string")
    locate.save_vectors(chunks, str(tmp_path / "v"))
    asked = spark.createDataFrame([("q", "whales blue")], "q string, question string")
    assert locate.search_vectors(asked, str(tmp_path / "v"), 1).first()["text"] == "blue whales"
    names = spark.createDataFrame([("x", "zebra stripes")], "id string, name string")
    nothing = spark.createDataFrame([("q", "unrelated words")], "q string, question string")
    assert link.link(nothing, names).count() == 0 and link.link(nothing, names, nearest=True).first()["id"] == "x"


def test_numbering_over_ranges(spark):
    rows = [(i % 2, (i * 37) % 11, i) for i in range(200)]
    got = numbered(spark.createDataFrame(rows, "g int, v int, i int").repartition(5), ["g"], [F.desc("v"), F.col("i")], ("v",)).collect()
    for g in (0, 1):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        places = {r["i"]: (r["k"], r["n"], r["sum_v"], r["all_v"]) for r in got if r["g"] == g}
        assert places == {r[2]: (k, 100, sum(x[1] for x in own[:k]), sum(x[1] for x in own)) for k, r in enumerate(own, 1)}
    labels = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, None, 0)], "k int, l string, o int")
    assert ordered_union(labels, ["k"], "l", "o", "all").first()["all"] == ["b", "a"]


def test_recalibration(spark):
    rows = [("s", i, (i % 10) / 10, float(i * 7 % 10 < (i % 10) / 2)) for i in range(400)]
    frame = spark.createDataFrame(rows, "system string, question_id int, confidence double, em double")
    before = metrics.ece(frame).first()["ece"]
    report = metrics.platt_report(frame, splits=3).first()
    assert report["ece"] < before and 0 < report["brier"] < 0.25
