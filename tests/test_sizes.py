"""What a hot key costs: rows made within plans, which must not grow with products of group sizes."""

import re

from pyspark.sql import functions as F

from pathloom.operators import link, options, reports, walk
from pathloom.operators.graph import Graph
from pathloom.plans import catalogue
from pathloom.sources import adjacency


def most_rows(frame):
    """The frame's rows, and the most rows that any part of its plan made."""
    got = frame.collect()
    seen, left = [], [frame._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        count = node.metrics().get("numOutputRows")
        seen.append(count.get().value() if count.isDefined() else 0)
        for own in ("finalPhysicalPlan", "plan"):
            if hasattr(node, own) and any(x in node.getClass().getSimpleName() for x in ("AdaptiveSparkPlan", "QueryStage")):
                try:
                    left.append(getattr(node, own)())
                except Exception:  # noqa: BLE001, the other of the two
                    continue
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return got, max(seen)


def test_entries_of_a_shared_name_are_cut_before_the_join(spark):
    names = spark.range(3000).select(F.concat(F.lit("p:"), "id").alias("id"), F.lit("red bolt").alias("name"))
    asked = spark.range(3000).select(F.col("id").alias("q"), F.lit("red bolt").alias("key"))
    found = link.exact_candidates(asked, link.name_index(names), 8)
    rows, most = most_rows(options.choose_entry(found, found.groupBy("q").agg(F.max("id").alias("id")).withColumn("p", F.lit(0.9))))
    first = sorted(f"p:{i}" for i in range(3000))[:8]
    assert len(rows) == 3000 and {r["id"] for r in rows} == {first[-1]} and most <= 8 * 3000


def test_recall_meets_each_name_once(spark):
    gold = spark.range(2000).select(F.col("id").alias("question_id"), F.lit("red bolt").alias("name")).union(spark.createDataFrame([(1, "none")], "question_id long, name string"))
    names = spark.range(2000).select(F.lit("red bolt").alias("key"), F.col("id").cast("string").alias("id"))
    (row,), most = most_rows(reports.entity_recall(gold, names))
    assert (row["gold"], row["found"], row["split"], row["over_merged"], row["recall"]) == (2, 1, 1, 0, 0.5)
    assert most <= 3000


def hub(spark, n):
    """``n`` customers of one nation, each with an order."""
    lives = spark.range(n).select(F.concat(F.lit("c:"), "id").alias("source"), F.lit("lives_in").alias("type"), F.lit("n:0").alias("target"))
    placed = spark.range(n).select(F.concat(F.lit("o:"), "id").alias("source"), F.lit("placed_by").alias("type"), F.concat(F.lit("c:"), "id").alias("target"))
    edges = lives.union(placed)
    ids = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return Graph(ids.select("id", F.lit("x").alias("type"), F.col("id").alias("name")), edges)


def test_relations_around_a_hub_are_counted_before_the_join(spark):
    g = hub(spark, 2000)
    starts = g.nodes.where("id like 'c:%'").select(F.col("id").alias("start"), F.col("id").alias("node"))
    for graph in (g, adjacency.stored_for_now(g, 4)):
        rows, most = most_rows(graph.local_relations(starts, 2, 1 << 30))
        assert {(r["rel"], r["n"]) for r in rows} == {("lives_in", 2001), ("placed_by", 2)} and len(rows) == 4000
        assert most <= 40_000


def standing(spark, rows):
    """Beams of ``(q, frontier, visited)``."""
    frame = spark.createDataFrame(rows, "q string, frontier array<string>, visited array<string>")
    return frame.select("q", F.lit("which orders").alias("question"), F.lit(1).cast("long").alias("beam"), "frontier", "visited")


def test_beams_at_a_hub_get_its_first_targets_without_a_row_for_each_of_all(spark):
    g, config = hub(spark, 2000), walk.WalkConfig(unit="relation", max_frontier=5)
    beams = standing(spark, [(f"q{i}", ["n:0"], [f"c:{i}", "n:0"]) for i in range(2000)])
    for graph in (g, adjacency.stored_for_now(g, 4)):
        rows, most = most_rows(walk.expand(graph, beams, config))
        first = sorted(f"c:{i}" for i in range(2000))
        got = {r["q"]: r["targets"] for r in rows}
        assert all(got[f"q{i}"] == [c for c in first if c != f"c:{i}"][:5] for i in range(2000)) and most <= 20_000


def test_listed_moves_are_the_same_as_met_ones(spark, monkeypatch):
    own = [(f"x{i % 7}", f"r{i % 2}", f"x{(i * i) % 11}") for i in range(60)] + [("x0", "r0", None), ("x1", "r0", "x1"), ("x0", "r0", "x3")]
    edges = spark.createDataFrame(own, "source string, type string, target string")
    g = Graph(spark.createDataFrame([(f"x{i}", "x", f"X {i}") for i in range(11)], "id string, type string, name string"), edges)
    places = [(f"q{i}", [f"x{(i + j) % 11}" for j in range(1 + i % 3)], [f"x{(i + j * j) % 11}" for j in range(5)] + [None] * (i % 2)) for i in range(40)]
    beams = standing(spark, places)
    for limit in (1, 2, 50):
        for directions in ("both", "out", "in"):
            config = walk.WalkConfig(unit="relation", max_frontier=limit, directions=directions)
            got = []
            for most in (10**9, 0, 8):
                monkeypatch.setattr(walk, "SHARED", most)
                got.append(sorted(map(str, walk.expand(g, beams, config).select("q", "beam", "ord", "rel", "dir", "targets").collect())))
            assert got[0] and got[0] == got[1] == got[2]


def test_near_targets_are_ranked_where_their_questions_met_them(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # these tables would be small enough to be sent
    try:
        plan = catalogue.queries()["frontier_cap_near"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(node#\d+, \d", plan) and not re.search(r"hashpartitioning\(node#\d+, rel#\d+", plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_relations_are_read_without_joining_nodes(spark):
    g = hub(spark, 20)
    for graph in (g, adjacency.stored_for_now(g, 4)):
        relations = graph.relations()
        assert {r["type"] for r in relations.collect()} == {"lives_in", "placed_by"}
        assert "Join" not in relations._jdf.queryExecution().executedPlan().toString()
