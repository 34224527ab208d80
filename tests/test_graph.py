"""Graph reads, changes and walks on small graphs with known answers."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.operators import decide, mutate, walk
from pathloom.operators.graph import Graph


def graph(spark, edges, names=None, kinds=None):
    ids = sorted({x for s, _, t in edges for x in (s, t)} | set(names or {}))
    nodes = spark.createDataFrame([(i, (kinds or {}).get(i, "entity"), (names or {}).get(i, i)) for i in ids], "id string, type string, name string")
    return Graph(nodes, spark.createDataFrame(edges, "source string, type string, target string"))


STAR = [("a", "r", "c"), ("a", "r", "b"), ("a", "s", "b"), ("d", "r", "a"), ("a", "loop", "a"), ("b", "r", "c")]
TRAP = [("A", "r", "B"), ("A", "r", "C"), ("B", "r", "D"), ("B", "r", "E"), ("C", "r", "D")]
WEIGHTS = [("A", "B", 0.55), ("A", "C", 0.45), ("B", "D", 0.3), ("B", "E", 0.3), ("B", "STOP", 0.4), ("C", "STOP", 0.99), ("C", "D", 0.01), ("D", "STOP", 1.0), ("E", "STOP", 1.0)]


def starts(spark, *nodes, question="?"):
    return spark.createDataFrame([(str(i), question, n, 0) for i, n in enumerate(nodes)], "q string, question string, node string, ord int")


def test_neighbor_order_and_self_loops(spark):
    g = graph(spark, STAR)
    near = g.neighbors(spark.createDataFrame([("a",)], "node string")).orderBy("position").collect()
    assert [(r["dir"], r["rel"], r["other"]) for r in near] == [("out", "loop", "a"), ("out", "r", "b"), ("out", "r", "c"), ("out", "s", "b"), ("in", "r", "d")]
    assert g.moves([]).count() == 0
    assert {r["node"]: r["degree"] for r in g.degrees().collect()} == {"a": 5, "b": 3, "c": 2, "d": 1}
    back = g.moves(None, "in").where("node = 'a'").collect()
    assert {(r["rel"], r["other"]) for r in back} == {("r", "d"), ("loop", "a")}
    with pytest.raises(ValueError):
        g.moves(None, "up")


def test_find_and_schema(spark):
    g = graph(spark, [("x", "likes", "y"), ("x", "likes", "z")], {"x": "Ann  Lee", "y": "Bob"}, {"x": "person", "y": "person", "z": "cat"})
    assert [r["id"] for r in g.find_nodes("ann lee").collect()] == ["x"]
    assert g.find_nodes("bob", "cat").count() == 0 and g.find_nodes(None, "person", -1).count() == 0
    assert g.schema().first()["edges"] == 2
    assert g.dangling().count() == 0


def test_paths_visit_no_node_twice(spark):
    g = graph(spark, [("m1", "directed_by", "n"), ("m2", "directed_by", "n"), ("m3", "directed_by", "n"), ("n", "born_in", "l")])
    out = g.follow(spark.createDataFrame([("q", "m1")], "q string, node string"), [("directed_by", "out"), ("directed_by", "in")])
    assert {r["node"] for r in out.collect()} == {"m2", "m3"}
    local = {r["rel"]: r["n"] for r in g.local_relations(spark.createDataFrame([("m1", "m1")], "start string, node string"), 2).collect()}
    assert local == {"directed_by": 4, "born_in": 1}  # the first edge counts from both of its ends


def test_beam_escapes_the_trap(spark):
    g = graph(spark, TRAP)
    table = decide.TableDecider(spark.createDataFrame(WEIGHTS, "cur string, opt string, w double"))
    greedy = walk.walk(g, starts(spark, "A"), table, walk.WalkConfig(strategy="greedy", width=1, directions="out")).where("rank = 1").first()
    assert greedy["frontier"] == ["B"]
    beam = walk.walk(g, starts(spark, "A"), table, walk.WalkConfig(directions="out")).where("rank = 1").first()
    assert beam["frontier"] == ["C"] and math.isclose(beam["score"], (math.log(0.45) + math.log(0.99)) / 2)


def test_scores_of_dead_ends(spark):
    g = graph(spark, [("A", "r", "B")])
    table = decide.TableDecider(spark.createDataFrame([("A", "B", 0.8)], "cur string, opt string, w double"))
    config = walk.WalkConfig(directions="out", stop_at_start=False)
    only = walk.walk(g, starts(spark, "A"), table, config).first()
    assert (only["n_decisions"], only["n_choices"], only["finished"]) == (1, 0, "dead_end") and math.isclose(only["confidence"], 1e-3)
    g = graph(spark, [("A", "r", "B"), ("A", "s", "C")])
    table = decide.TableDecider(spark.createDataFrame([("A", "B", 0.8), ("A", "C", 0.2)], "cur string, opt string, w double"))
    best = walk.walk(g, starts(spark, "A"), table, config).where("rank = 1").first()
    assert (best["n_choices"], best["n_decisions"]) == (1, 2) and math.isclose(best["confidence"], math.sqrt(0.8))


def test_relation_walk_and_samples(spark):
    g = graph(spark, [("m1", "directed_by", "n"), ("m2", "directed_by", "n"), ("m3", "directed_by", "n")])
    lexical = decide.LexicalDecider(stop_weight=0.1)
    got = walk.walk(g, starts(spark, "m1", question="who directed by"), lexical, walk.WalkConfig(strategy="greedy", unit="relation", stop_at_start=False)).first()
    assert got["frontier"] == ["m2", "m3"] and got["finished"] == "dead_end"
    g = graph(spark, [("i", "r", "nolan"), ("i", "r", "dicaprio")])
    table = decide.TableDecider(spark.createDataFrame([("i", "nolan", 0.6), ("i", "dicaprio", 0.4)], "cur string, opt string, w double"))
    votes = walk.sampled(g, starts(spark, "i"), table, walk.WalkConfig(max_depth=1, stop_at_start=False, directions="out"), 20).orderBy("rank").collect()
    assert sum(r["votes"] for r in votes) == 20 and votes[0]["votes"] >= votes[-1]["votes"]


def test_unsure_walks_go_to_the_fallback(spark):
    g = graph(spark, [("A", "r", "B"), ("A", "s", "C")])
    weak = decide.TableDecider(spark.createDataFrame([("A", "B", 0.5), ("A", "C", 0.5)], "cur string, opt string, w double"))
    sure = decide.TableDecider(spark.createDataFrame([("A", "C", 1.0)], "cur string, opt string, w double"))
    config = walk.WalkConfig(strategy="greedy", width=1, max_depth=1, stop_at_start=False, directions="out")
    best = walk.escalated(g, starts(spark, "A"), weak, sure, 0.9, config).where("rank = 1").first()
    assert best["escalated"] and best["frontier"] == ["C"]


def brute_beam(adj, start, weights, width, depth, floor=1e-3):
    """A plain walk over entities, one question, as the batched one should do it."""
    beams = [([start], [start], 0.0, 0, 0, None)]
    archive = []
    score = lambda b: math.log(floor) if b[4] == 0 and b[3] else (0.0 if not b[3] else b[2] / b[3])
    for d in range(depth):
        pool = [b for b in beams if b[5]]
        for b in [b for b in beams if not b[5]]:
            node = b[0][0]
            options = [(o, weights[node, o]) for o in adj.get(node, []) if o not in b[1]]
            options.append(("STOP", weights[node, "STOP"])) if options else None
            if not options:
                pool.append((b[0], b[1], b[2], b[3] + 1, b[4], "dead_end"))
                continue
            total = sum(w for _, w in options)
            for o, w in options:
                logp = math.log(max(w / total, floor))
                pool.append((b[0], b[1], b[2] + logp, b[3] + 1, b[4] + 1, "stop") if o == "STOP" else ([o], b[1] + [o], b[2] + logp, b[3] + 1, b[4] + 1, None))
        old = {id(b) for b in beams}
        beams = [b for _, b in sorted(enumerate(pool), key=lambda x: (-score(x[1]), x[0]))[:width]]
        archive += [b for b in beams if b[5] and id(b) not in old]
        if all(b[5] for b in beams):
            break
    best = {}
    for b in archive + [b for b in beams if not b[5]]:
        best[b[0][0]] = max(best.get(b[0][0], -1e9), round(score(b), 9))
    return best


def test_batched_beams_equal_single_walks(spark):
    rng = random.Random(11)
    nodes = [f"n{i:02d}" for i in range(24)]
    edges = sorted({(a, "r", b) for a in nodes for b in rng.sample(nodes, 3) if a != b})
    adj = {}
    for a, _, b in edges:
        adj.setdefault(a, []).append(b)
    weights = {(a, o): rng.randrange(1, 1000) / 1000 for a in nodes for o in adj[a] + ["STOP"]}
    table = decide.TableDecider(spark.createDataFrame([(a, o, w) for (a, o), w in weights.items()], "cur string, opt string, w double"))
    got = {}
    for r in walk.walk(graph(spark, edges), starts(spark, *nodes[:6]), table, walk.WalkConfig(directions="out")).collect():
        got.setdefault(r["q"], {})[r["frontier"][0]] = round(r["score"], 9)
    for i, node in enumerate(nodes[:6]):
        assert got[str(i)] == brute_beam({k: sorted(v) for k, v in adj.items()}, node, weights, 3, 3)


def test_changes(spark):
    g = graph(spark, STAR)
    left = mutate.delete_nodes(g, spark.createDataFrame([("b",)], "id string"))
    assert left.nodes.count() == 3 and left.edges.count() == 3
    merged = mutate.rewired(g.edges.withColumn("n", F.lit(1)), spark.createDataFrame([("b", "a")], "absorbed string, keep string"))
    assert {(r["source"], r["type"], r["target"]): r["n"] for r in merged.collect()} == {("a", "r", "c"): 2, ("d", "r", "a"): 1, ("a", "loop", "a"): 1}
    rows = [("x", "born", "1867", 1, "d1"), ("x", "born", "1868", 2, "d2"), ("x", "born", "1867", 3, "d3"), ("x", "city", "Paris", 1, "d2")]
    attributes = spark.createDataFrame(rows, "id string, key string, value string, ord int, source_id string")
    kept, conflicts = mutate.fold(attributes)
    assert {(r["key"], r["value"], tuple(r["sources"])) for r in kept.collect()} == {("born", "1867", ("d1", "d3")), ("city", "Paris", ("d2",))}
    assert {r["value"] for r in conflicts.collect()} == {"1867", "1868"}
    provenance = attributes.select(F.col("id").alias("element"), "source_id").union(spark.createDataFrame([("y", "d1")], "element string, source_id string"))
    gone, current = mutate.retract(provenance, attributes, spark.createDataFrame([("d1",), ("d3",)], "source_id string"))
    assert [r["element"] for r in gone.collect()] == ["y"]
    assert {(r["key"], r["value"]) for r in current.collect()} == {("born", "1868"), ("city", "Paris")}
    mapping = spark.createDataFrame([("director_of", "director", True), ("directed_by", "director", False)], "type string, new_type string, reversed boolean")
    edges = spark.createDataFrame([("m", "directed_by", "p", 1), ("p", "director_of", "m", 1)], "source string, type string, target string, n long")
    assert [(r["source"], r["type"], r["target"], r["n"]) for r in mutate.rename_relations(edges, mapping).collect()] == [("m", "director", "p", 2)]


def test_reshaping(spark):
    options = spark.createDataFrame([("q", 1, i, k, p) for i, (k, p) in enumerate([("a", 0.5), ("b", 0.3), ("c", 0.15), ("d", 0.05)])], "q string, beam long, ord long, key string, p double")
    shaped = {r["key"]: round(r["r"], 6) for r in decide.reshaped(options, 1.0, 0.8).collect()}
    assert shaped == {"a": 0.625, "b": 0.375, "c": 0.0, "d": 0.0}
    cold = {r["key"]: r["r"] for r in decide.reshaped(options, 0).collect()}
    assert cold == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}
    moved = decide.shuffled(options, "seed")
    assert Counter(r["key"] for r in moved.collect()) == Counter("abcd") and sorted(r["ord"] for r in moved.collect()) == [1, 2, 3, 4]
    bad = decide.normalized(spark.createDataFrame([("q", 1, 1, "a", -1.0), ("q", 1, 2, "b", 2.0)], "q string, beam long, ord long, key string, w double"))
    assert all(r["p"] is None for r in bad.collect())
