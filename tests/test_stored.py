"""Graphs in buckets, and the first rows of large groups."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import decide, evaluate, walk
from pathloom.operators.lineage import first_rows
from pathloom.sources import adjacency

from .test_graph import STAR, graph, starts


def rows(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    """A graph with a hub, and the same in buckets."""
    rng = random.Random(3)
    edges = sorted({("hub", rng.choice("rs"), f"n{i}") for i in range(300)} | {(f"n{rng.randrange(300)}", "t", f"n{rng.randrange(300)}") for _ in range(200)} | set(STAR))
    plain = graph(spark, edges)
    return plain, adjacency.store(plain, str(tmp_path_factory.mktemp("stored") / "g"), 4)


def test_moves_are_the_same(spark, pair):
    plain, stored = pair
    frontier = spark.createDataFrame([("hub", 1), ("a", 2), ("n5", 3), ("n5", 4), ("none", 5)], "node string, mark int")
    for direction in ("out", "in", "both"):
        for types in (None, ["r"], ["r", "loop"], []):
            assert rows(stored.moves(types, direction)) == rows(plain.moves(types, direction))
            assert rows(stored.meet(frontier, types, direction)) == rows(plain.meet(frontier, types, direction))
    with pytest.raises(ValueError):
        stored.moves(None, "up")
    assert rows(stored.nodes) == rows(plain.nodes) and rows(stored.adjacency) == rows(plain.adjacency)
    near = frontier.select("node").distinct()
    assert rows(stored.neighbors(near)) == rows(plain.neighbors(near))
    assert rows(stored.relation_histogram(near)) == rows(plain.relation_histogram(near))


def test_a_hub_lies_in_several_buckets(pair):
    _, stored = pair
    hub = stored.stored.where("node = 'hub'")
    assert hub.select("salt").distinct().count() > 4 and hub.select(F.input_file_name()).distinct().count() > 2
    assert stored.hubs.count() < 4 * 4
    largest = stored.stored.groupBy("node", "salt").count().agg(F.max("count")).first()[0]
    assert largest < 0.2 * stored.stored.count()


def exchanges_above_scans(plan, table):
    """How many exchanges lie above the scans of a table, in a formatted tree of a plan."""
    lines = plan.splitlines()
    found = 0
    for i, line in enumerate(lines):
        if "FileScan" in line and table in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            for above in reversed(lines[:i]):
                own = len(above) - len(above.lstrip(" :+-"))
                if own < depth:
                    depth = own
                    if "Join" in above:
                        break
                    found += "Exchange" in above
    return found


def test_no_shuffle_of_edges(spark, pair):
    plain, stored = pair
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # these edges would be small enough to be sent
    try:
        frontier = spark.createDataFrame([("hub",), ("a",)], "node string")
        for types, direction in ((None, "both"), (["r"], "in"), (["t"], "out")):
            plan = stored.meet(frontier, types, direction)._jdf.queryExecution().executedPlan().toString()
            assert "FileScan" in plan and exchanges_above_scans(plan, "stored_") == 0
        seeded = walk.seed_beams(starts(spark, "hub", "a"), walk.WalkConfig(unit="relation"))
        plan = walk.expand(stored, seeded, walk.WalkConfig(unit="relation"))._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" in plan and exchanges_above_scans(plan, "stored_") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_walks_are_the_same(spark, pair):
    plain, stored = pair
    asked = starts(spark, "hub", "a", "n7", "none", question="who is n12 or loop")
    for config in (walk.WalkConfig(unit="relation", width=2, max_depth=2), walk.WalkConfig(unit="entity", width=2, max_depth=2, max_options=20)):
        assert rows(walk.walk(stored, asked, decide.LexicalDecider(), config)) == rows(walk.walk(plain, asked, decide.LexicalDecider(), config))
    at = spark.createDataFrame([("q1", "hub"), ("q2", "a")], "q string, node string")
    assert rows(stored.follow(at, [("r", "out"), ("t", "in")])) == rows(plain.follow(at, [("r", "out"), ("t", "in")]))
    around = at.withColumnRenamed("q", "start")
    assert rows(stored.local_relations(around, 2, 40)) == rows(plain.local_relations(around, 2, 40))
    paths = spark.createDataFrame([("q1", [("r", "out"), ("t", "out")]), ("q2", [("s", "out")])], "q string, path array<struct<relation:string,direction:string>>")
    assert rows(evaluate.run_paths(stored, paths, at)) == rows(evaluate.run_paths(plain, paths, at))


def test_opened_again(spark, pair, tmp_path):
    plain, _ = pair
    path = str(tmp_path / "it's")
    assert not adjacency.is_stored(spark, path)
    adjacency.store(plain, path, 3)
    assert adjacency.is_stored(spark, path)
    assert rows(adjacency.open_stored(spark, path).edges) == rows(plain.edges)
    empty = adjacency.store(plain.cleared(), str(tmp_path / "empty"), 2)
    assert empty.adjacency.count() == 0 and empty.hubs.count() == 0


@pytest.mark.parametrize("limit", [3, 1500])
def test_first_rows(spark, limit):
    frame = spark.range(9000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(997)).alias("v"), "id")
    got = {(r["g"], r["n"]): r["id"] for r in first_rows(frame, ["g"], [F.desc("v"), F.col("id")], limit).collect()}
    want = {}
    for g in range(3):
        own = sorted(((-r["v"], r["id"]) for r in frame.where(f"g = {g}").collect()))[:limit]
        want |= {(g, n): i for n, (_, i) in enumerate(own, 1)}
    assert got == want
    if limit > 1000:
        plan = first_rows(frame, ["g"], ["v", "id"], limit)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window ") >= 2  # each task's first rows, then the group's


def test_targets_near_the_question(spark):
    """Ties keep the order, those kept stay in it, and small groups stay whole."""
    named = [("q", "q1", "red apple tart", f"t{i}", name) for i, name in enumerate(["blue", "red", "apple pie", "apple red", "tart", "x"])]
    frame = spark.createDataFrame(named + [("q", "q2", "red", "t9", "blue")], "q string, rel string, question string, other string, name string")
    for by in ("overlap", "similarity"):
        got = {(r["rel"], r["n"]): r["other"] for r in walk.cap_targets_near(frame, ["q", "rel"], ["other"], 2, by).collect()}
        assert got[("q2", 1)] == "t9" and len(got) == 3
        assert by == "similarity" or got == {("q1", 1): "t1", ("q1", 2): "t3", ("q2", 1): "t9"}
    with pytest.raises(ValueError):
        walk.cap_targets_near(frame, ["q"], ["other"], 2, "size")


def test_walk_keeps_near_targets(spark):
    g = graph(spark, [("s", "r", f"n{i}") for i in range(6)], {f"n{i}": n for i, n in enumerate(["ash", "oak", "red elm", "fir", "elm", "yew"])} | {"s": "s"})
    config = walk.WalkConfig(strategy="greedy", unit="relation", max_depth=1, max_frontier=2, stop_at_start=False)
    asked = starts(spark, "s", question="which elm is it")
    first = walk.walk(g, asked, decide.LexicalDecider(), config).first()
    near = walk.walk(g, asked, decide.LexicalDecider(), walk.replace(config, frontier_by="overlap")).first()
    assert first["frontier"] == ["n0", "n1"] and near["frontier"] == ["n2", "n4"]
