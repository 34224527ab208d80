"""Queries over the given tables, one for each operator, with their SQL where it can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import decide, evaluate, ingest, link, locate, merge, metrics, mutate, options, reports, walk
from ..operators.graph import Graph, elements_from, ordered_union
from ..operators.lineage import scratch_path, settled
from ..sources import adjacency, datasets, ordered
from ..sources import replies as reply_store
from ..sources import snapshot
from ..sources import triples as triple_io
from .star import GRAPH_SQL, SCORES_SQL, Tables, node_id, scores, star_graph, triples

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            _SQL[name] = sql
        return build

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes))


def stored_star(t: Tables) -> adjacency.StoredGraph:
    """The tables' graph, written once in buckets: what steps through it shuffles its frontiers alone."""
    return adjacency.stored_for_now(star_graph(t))


# --- graph from triples -------------------------------------------------------

@query("triples_star", GRAPH_SQL + "SELECT subject, relation, object, count(*)::BIGINT AS n FROM triples GROUP BY ALL")
def triples_star(t):
    return triples(t).groupBy("subject", "relation", "object").agg(F.count("*").alias("n"))


@query("edge_ids", GRAPH_SQL + "SELECT source, type, target, 'e:' || substr(sha256(source || chr(31) || type || chr(31) || target), 1, 32) AS id FROM edges")
def edge_ids(t):
    return star_graph(t).edges.withColumn("id", X.edge_id(F.col("source"), F.col("type"), F.col("target")))


@query("nodes_star", GRAPH_SQL + "SELECT id, type, name FROM nodes")
def nodes_star(t):
    return star_graph(t).nodes


@query("ordered_nodes", GRAPH_SQL + "SELECT id, type, name, row_number() OVER (ORDER BY id) - 1 AS position, (row_number() OVER (ORDER BY id) - 1) // 1000 AS page FROM nodes")
def ordered_nodes(t):
    nodes = star_graph(t).nodes
    stored = ordered.write_ordered(nodes, scratch_path(nodes.sparkSession, "ordered"), ["id"])
    return stored.numbered().withColumn("page", F.floor(F.col("position") / 1000).cast("long"))


@query("node_names_index", GRAPH_SQL + "SELECT DISTINCT id, name, lower(name) AS key FROM nodes")
def node_names_index(t):
    return star_graph(t).names


@query("import_report", GRAPH_SQL + ", seen AS (SELECT source AS id FROM edges UNION SELECT target FROM edges) SELECT (SELECT count(*) FROM seen s WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = s.id AND n.type IN ('region', 'nation')))::BIGINT AS new_nodes, (SELECT count(*) FROM edges)::BIGINT AS edges")
def import_report(t):
    g = star_graph(t)
    rows = triples(t).select(F.monotonically_increasing_id().alias("ord"), "*", *(F.lit(None).cast("string").alias(c) for c in triple_io.COLUMNS[3:]))
    old = g.nodes.where("type in ('region', 'nation')")
    return triple_io.import_triples(old, g.edges.limit(0), rows)[2]


@query("adjacency_both", GRAPH_SQL + "SELECT * FROM adj")
def adjacency_both(t):
    return star_graph(t).adjacency


@query("neighbors_node", GRAPH_SQL + """SELECT a.node, a.rel, a.dir, a.other, row_number() OVER (PARTITION BY a.node ORDER BY a.dir <> 'out', a.rel, a.other)::BIGINT AS position, n.name AS other_name, n.type AS other_type
FROM adj a JOIN nodes n ON n.id = a.other WHERE a.node IN (SELECT id FROM nodes WHERE type IN ('nation', 'supplier'))""")
def neighbors_node(t):
    g = star_graph(t)
    return g.neighbors(g.nodes.where("type in ('nation', 'supplier')").select(F.col("id").alias("node")))


@query("neighbors_typed", GRAPH_SQL + """SELECT a.node, a.rel, a.dir, a.other, row_number() OVER (PARTITION BY a.node ORDER BY a.dir <> 'out', a.rel, a.other)::BIGINT AS position, n.name AS other_name, n.type AS other_type
FROM adj a JOIN nodes n ON n.id = a.other WHERE a.dir = 'in' AND a.rel IN ('placed_by', 'contains') AND a.node IN (SELECT id FROM nodes)""")
def neighbors_typed(t):
    g = star_graph(t)
    return g.neighbors(g.nodes.select(F.col("id").alias("node")), ["placed_by", "contains"], "in")


@query("degree_by_relation", GRAPH_SQL + "SELECT node, dir, rel, count(*)::BIGINT AS degree FROM adj GROUP BY ALL")
def degree_by_relation(t):
    return star_graph(t).degrees_by_relation()


@query("degrees", GRAPH_SQL + "SELECT node, count(*)::BIGINT AS degree FROM adj GROUP BY node")
def degrees(t):
    return star_graph(t).degrees()


@query("relation_histogram", GRAPH_SQL + "SELECT rel, dir, count(*)::BIGINT AS n FROM adj GROUP BY ALL")
def relation_histogram(t):
    return star_graph(t).relation_histogram()


_TYPED = ", typed AS (SELECT e.*, a.type AS source_type, b.type AS target_type FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target)"


@query("schema_inference", GRAPH_SQL + _TYPED + """, pairs AS (SELECT type, source_type, target_type, count(*) AS n, min('e:' || substr(sha256(source || chr(31) || type || chr(31) || target), 1, 32)) AS first FROM typed GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY type) AS edges, row_number() OVER (PARTITION BY type ORDER BY n DESC, first) AS r FROM pairs)
SELECT type, edges::BIGINT AS edges, source_type, target_type FROM ranked WHERE r = 1""")
def schema_inference(t):
    return star_graph(t).schema()


@query("relation_signature", GRAPH_SQL + _TYPED + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY source, target) AS r FROM typed) SELECT type, source_type, target_type FROM ranked WHERE r = 1")
def relation_signature(t):
    return star_graph(t).relation_signature()


@query("top_node_types", GRAPH_SQL + "SELECT type, count(*)::BIGINT AS n FROM nodes GROUP BY type ORDER BY n DESC, type LIMIT 50")
def top_node_types(t):
    return star_graph(t).top_types()


@query("path_orders_of_region", GRAPH_SQL + """SELECT r.id AS q, p.source AS node FROM nodes r JOIN edges i ON i.type = 'in_region' AND i.target = r.id
JOIN edges l ON l.type = 'lives_in' AND l.target = i.source JOIN edges p ON p.type = 'placed_by' AND p.target = l.source WHERE r.type = 'region' GROUP BY ALL""")
def path_orders_of_region(t):
    g = stored_star(t)
    starts = g.nodes.where("type = 'region'").select(F.col("id").alias("q"), F.col("id").alias("node"))
    return g.follow(starts, [("in_region", "in"), ("lives_in", "in"), ("placed_by", "in")])


@query("path_parts_of_nation", GRAPH_SQL + """SELECT DISTINCT n.id AS q, s.source AS node FROM nodes n JOIN edges b ON b.type = 'based_in' AND b.target = n.id
JOIN edges s ON s.type = 'supplied_by' AND s.target = b.source WHERE n.type = 'nation'""")
def path_parts_of_nation(t):
    g = stored_star(t)
    starts = g.nodes.where("type = 'nation'").select(F.col("id").alias("q"), F.col("id").alias("node"))
    return g.follow(starts, [("based_in", "in"), ("supplied_by", "in")])


@query("bfs_relation_counts", GRAPH_SQL + """, near AS (SELECT id AS start, id AS node FROM nodes WHERE type = 'customer'
UNION SELECT n.id, a.other FROM nodes n JOIN adj a ON a.node = n.id WHERE n.type = 'customer')
SELECT start, rel, count(*)::BIGINT AS n FROM near JOIN adj USING (node) GROUP BY ALL""")
def bfs_relation_counts(t):
    g = stored_star(t)
    return g.local_relations(g.nodes.where("type = 'customer'").select(F.col("id").alias("start"), F.col("id").alias("node")), 2, 1 << 30)


@query("find_by_name_ci", GRAPH_SQL + "SELECT n.id, n.type, n.name, (SELECT count(*) FROM nodes m WHERE lower(m.name) = lower(n.name))::BIGINT AS same_name FROM nodes n")
def find_by_name_ci(t):
    g = star_graph(t)
    same = g.names.groupBy("key").agg(F.count("*").alias("same_name"))
    return g.nodes.withColumn("key", F.lower("name")).join(same, "key").drop("key")


@query("find_nodes_typed", GRAPH_SQL + "SELECT id, type, name FROM nodes WHERE type = 'nation' AND lower(name) = 'nation_7'")
def find_nodes_typed(t):
    return star_graph(t).find_nodes("Nation_7", "nation")


@query("get_nodes_semi", GRAPH_SQL + "SELECT id, type, name FROM nodes WHERE id IN (SELECT source FROM edges WHERE type = 'supplied_by')")
def get_nodes_semi(t):
    g = star_graph(t)
    return g.get_nodes(g.edges.where("type = 'supplied_by'").select(F.col("source").alias("id")))


@query("counts", GRAPH_SQL + "SELECT (SELECT count(*) FROM nodes)::BIGINT AS n_nodes, (SELECT count(*) FROM edges)::BIGINT AS n_edges")
def counts(t):
    return star_graph(t).counts()


@query("dangling_edges", GRAPH_SQL + ", held AS (SELECT id FROM nodes WHERE type NOT IN ('region', 'supplier')) SELECT source, type, target FROM edges WHERE source NOT IN (SELECT id FROM held) OR target NOT IN (SELECT id FROM held)")
def dangling_edges(t):
    g = star_graph(t)
    return Graph(g.nodes.where("type not in ('region', 'supplier')"), g.edges).dangling().select("source", "type", "target")


@query("elements_by_source", "SELECT DISTINCT 'document' AS kind, 'd:' || doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def elements_by_source(t):
    elements = t.documents.select(F.lit("document").alias("kind"), node_id("d", "doc_id").alias("id"), F.array(F.struct(F.concat(F.lit("label:"), "doc_id").alias("source_id"), F.lit(1.0).alias("confidence"))).alias("provenance"))
    return elements_from(elements, t.labels.where("quality = 0").select(F.concat(F.lit("label:"), "doc_id").alias("source_id")))


@query("status", "SELECT source, count(*)::BIGINT AS n, count(*) FILTER (text IS NULL)::BIGINT AS hash_only FROM documents GROUP BY source")
def status(t):
    return snapshot.status(t.documents)


# --- walks --------------------------------------------------------------------

def customer_questions(t) -> DataFrame:
    """One question for each customer, starting at its node."""
    return t.customer.select(node_id("c", "c_custkey").alias("q"), F.concat(F.lit("which parts do the orders placed by "), "c_name", F.lit(" contains")).alias("question"), node_id("c", "c_custkey").alias("node"), F.lit(0).alias("ord"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    config = walk.WalkConfig(strategy="greedy", unit="relation", max_depth=2, stop_at_start=False, max_frontier=2000)
    answers = walk.walk(stored_star(t), customer_questions(t), decide.LexicalDecider(stop_weight=0.5), config)
    return answers.select("q", F.array_join("frontier", ",").alias("frontier"), F.round("confidence", 6).alias("confidence"), "finished", "n_decisions", "rank")


_WORDS_SQL = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{3,}}'))"
_KEY_SQL = "CASE WHEN dir = 'in' THEN rel || '^-1' ELSE rel END"


def _step_sql(beams: str, out: str, stop: float | None) -> str:
    """One greedy step in SQL: from ``beams(q, question, nodes, seen, logp, decisions, choices, finished)`` to ``out``."""
    offered = f"SELECT q, question, rel, dir, key, targets, w, ord FROM {out}_weighed"
    if stop is not None:
        offered += f" UNION ALL SELECT q, question, NULL, NULL, 'STOP', NULL, {stop}::DOUBLE, max(ord) + 1 FROM {out}_weighed GROUP BY q, question"
    return f"""{out}_at AS (SELECT q, question, seen, unnest(nodes) AS node, unnest(range(len(nodes))) AS place FROM {beams} WHERE finished IS NULL),
{out}_met AS (SELECT q, question, rel, dir, other, min(place) AS place FROM {out}_at JOIN adj USING (node) WHERE NOT list_contains(seen, other) GROUP BY ALL),
{out}_first AS (SELECT *, row_number() OVER (PARTITION BY q, rel, dir ORDER BY place, other) AS n FROM {out}_met),
{out}_moves AS (SELECT q, question, rel, dir, {_KEY_SQL} AS key, list(other ORDER BY n) AS targets FROM {out}_first WHERE n <= 2000 GROUP BY ALL),
{out}_weighed AS (SELECT *, 1.0::DOUBLE + len(list_intersect({_WORDS_SQL.format('question')}, {_WORDS_SQL.format("replace(key, '_', ' ')")})) AS w, row_number() OVER (PARTITION BY q ORDER BY dir <> 'out', rel) AS ord FROM {out}_moves),
{out}_offered AS ({offered}),
{out}_ranked AS (SELECT *, w / sum(w) OVER (PARTITION BY q) AS p, count(*) OVER (PARTITION BY q) AS n, row_number() OVER (PARTITION BY q ORDER BY w DESC, ord) AS r FROM {out}_offered),
{out} AS (SELECT b.q, b.question, CASE WHEN c.targets IS NULL THEN b.nodes ELSE c.targets END AS nodes, CASE WHEN c.targets IS NULL THEN b.seen ELSE list_concat(b.seen, c.targets) END AS seen,
  b.logp + CASE WHEN c.n >= 2 THEN ln(greatest(c.p, 0.001)) ELSE 0 END AS logp, b.decisions + CASE WHEN c.q IS NULL OR c.n >= 2 THEN 1 ELSE 0 END AS decisions, b.choices + CASE WHEN c.n >= 2 THEN 1 ELSE 0 END AS choices,
  CASE WHEN c.q IS NULL THEN 'dead_end' WHEN c.key = 'STOP' THEN 'stop' END AS finished
  FROM {beams} b LEFT JOIN {out}_ranked c ON c.q = b.q AND c.r = 1 WHERE b.finished IS NULL UNION ALL SELECT * FROM {beams} WHERE finished IS NOT NULL)"""


_GREEDY_SQL = GRAPH_SQL + f""", start AS (SELECT 'c:' || c_custkey AS q, 'which parts do the orders placed by ' || c_name || ' contains' AS question, ['c:' || c_custkey] AS nodes, ['c:' || c_custkey] AS seen, 0.0::DOUBLE AS logp, 0::BIGINT AS decisions, 0::BIGINT AS choices, NULL::VARCHAR AS finished FROM customer),
{_step_sql('start', 'one', None)},
{_step_sql('one', 'two', 0.5)}
SELECT q, array_to_string(list_sort(nodes), ',') AS frontier, round(exp(CASE WHEN decisions = 0 THEN 0 WHEN choices = 0 THEN ln(0.001) ELSE logp / decisions END), 6) AS confidence, coalesce(finished, 'max_depth') AS finished, decisions::BIGINT AS n_decisions, 1::INTEGER AS rank FROM two"""
_SQL["greedy_walk_lexical"] = _GREEDY_SQL
_QUERIES["greedy_walk_lexical"] = flagship


@query("beam_walk_lexical")
def beam_walk_lexical(t):
    return walk.walk(stored_star(t), customer_questions(t), decide.LexicalDecider(), walk.WalkConfig(unit="relation", width=2, max_depth=2))


@query("beam_walk_table")
def beam_walk_table(t):
    table = t.spark.createDataFrame([("lives_in", 0.6), ("placed_by^-1", 0.3), ("STOP", 0.1), ("in_region", 0.7), ("based_in^-1", 0.2)], "opt string, w double")
    decisions = t.customer.select(F.col("c_name").alias("cur")).union(t.nation.select("n_name")).distinct().crossJoin(F.broadcast(table))
    return walk.walk(stored_star(t), customer_questions(t), decide.TableDecider(decisions), walk.WalkConfig(unit="relation", width=2, max_depth=2, directions="both"))


@query("sample_walk_votes")
def sample_walk_votes(t):
    return walk.sampled(stored_star(t), customer_questions(t), decide.LexicalDecider(), walk.WalkConfig(unit="relation", max_depth=2), 8)


@query("escalated_walks")
def escalated_walks(t):
    config = walk.WalkConfig(strategy="greedy", unit="relation", max_depth=2, stop_at_start=False)
    return walk.escalated(stored_star(t), customer_questions(t), decide.LexicalDecider(), decide.LexicalDecider(stop_weight=2.0), 0.75, config)


def supplier_options(t) -> DataFrame:
    """A question for each supplier: which of its parts; an option's weight is the quantity delivered."""
    rows = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("w"))
    return rows.select(F.col("l_suppkey").cast("string").alias("q"), F.lit(1).cast("long").alias("beam"), F.col("l_partkey").alias("ord"), F.col("l_partkey").cast("string").alias("key"), "w")


_OPTIONS_SQL = "WITH options AS (SELECT l_suppkey::VARCHAR AS q, l_partkey AS ord, l_partkey::VARCHAR AS key, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), probs AS (SELECT *, w / sum(w) OVER (PARTITION BY q) AS p FROM options)\n"


@query("normalized_options", _OPTIONS_SQL + "SELECT q, ord, key, round(p, 9) AS p FROM probs")
def normalized_options(t):
    return rounded(decide.normalized(supplier_options(t)), 9).select("q", "ord", "key", "p")


@query("choice_confidence", _OPTIONS_SQL + "SELECT q, count(*)::BIGINT AS n, round(CASE WHEN count(*) < 2 THEN 1 ELSE least(1, greatest(0, (count(*) * max(p) - 1) / (count(*) - 1))) END, 6) AS confidence FROM probs GROUP BY q")
def choice_confidence(t):
    top = decide.normalized(supplier_options(t)).groupBy("q").agg(F.count("*").alias("n"), F.max("p").alias("p"))
    return rounded(top.select("q", "n", decide.choice_confidence(F.col("n"), F.col("p")).alias("confidence")))


@query("top_option", _OPTIONS_SQL + ", ranked AS (SELECT *, count(*) OVER (PARTITION BY q) AS n, row_number() OVER (PARTITION BY q ORDER BY p DESC, ord) AS r FROM probs) SELECT q, key, round(p, 9) AS p, n::BIGINT AS n FROM ranked WHERE r = 1")
def top_option(t):
    return rounded(decide.top_option(decide.normalized(supplier_options(t))), 9).select("q", "key", "p", "n")


@query("nucleus_reshape", _OPTIONS_SQL + """, running AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY q ORDER BY p DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM probs),
kept AS (SELECT * FROM running WHERE before < 0.5 - 1e-9) SELECT q, key, round(p / sum(p) OVER (PARTITION BY q), 6) AS r FROM kept""")
def nucleus_reshape(t):
    shaped = decide.reshaped(decide.normalized(supplier_options(t)), 1.0, 0.5)
    return rounded(shaped.where("r > 0").select("q", "key", "r"))


@query("beam_prune", _OPTIONS_SQL + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ln(greatest(p, 0.001)) DESC, ord) AS beam FROM probs) SELECT q, key, beam::BIGINT AS beam FROM ranked WHERE beam <= 3")
def beam_prune(t):
    scored = decide.normalized(supplier_options(t)).withColumn("score", walk.path_score(F.log(F.greatest("p", F.lit(1e-3))), F.lit(1), F.lit(1), 1.0, 1e-3))
    return walk.keep_best(scored, [F.desc("score"), F.col("ord")], 3).select("q", "key", "beam")


@query("path_scores", SCORES_SQL + "SELECT system, question_id, round(CASE WHEN calls = 0 THEN ln(0.001) ELSE ln(greatest(f1, 0.001)) / calls END, 6) AS score FROM scores")
def path_scores(t):
    s = scores(t)
    value = walk.path_score(F.log(F.greatest("f1", F.lit(1e-3))), F.greatest("calls", F.lit(1)), F.col("calls"), 1.0, 1e-3)
    return rounded(s.select("system", "question_id", value.alias("score")))


@query("walk_answers_grouped", """WITH b AS (SELECT l_orderkey AS q, l_linestatus AS s, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS frontier, count(*) AS n, l_linestatus <> 'F' AS open FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q, frontier ORDER BY open, n, s) AS i, count(*) OVER (PARTITION BY q, frontier) AS votes FROM b)
SELECT q::VARCHAR AS q, frontier, votes::BIGINT AS votes, round(exp(-n / 2.0::DOUBLE), 6) AS confidence, row_number() OVER (PARTITION BY q ORDER BY open, n, s)::INTEGER AS rank FROM r WHERE i = 1""")
def walk_answers_grouped(t):
    ends = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("q"), "l_linestatus").agg(F.collect_set("l_returnflag").alias("frontier"), (-F.count("*")).cast("double").alias("sum_logp"))
    two = F.lit(2).cast("long")
    closed = F.col("l_linestatus") == "F"
    beams = ends.select("q", "frontier", "sum_logp", two.alias("n_decisions"), two.alias("n_choices"), F.when(closed, "stop").otherwise("max_depth").alias("finished"), F.lit(1).alias("depth"), F.when(closed, 1).otherwise(2).alias("beam"), F.array().cast("array<string>").alias("path"), F.col("q").alias("start"))
    return rounded(walk.grouped_answers(beams).select("q", F.array_join("frontier", ",").alias("frontier"), "votes", "confidence", "rank"))


@query("option_prefilter_overlap", """WITH options AS (SELECT DISTINCT l_suppkey AS q, l_partkey AS ord FROM lineitem), named AS (SELECT q, ord, p_name AS key, s_name || ' ' || p.p_type AS question FROM options JOIN part p ON p_partkey = ord JOIN supplier ON s_suppkey = q),
shared AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]{3,}')), list_distinct(regexp_extract_all(lower(key), '[a-z0-9]{3,}')))) AS n FROM named),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, ord) AS r FROM shared) SELECT q::VARCHAR AS q, ord, key FROM ranked WHERE r <= 10""")
def option_prefilter_overlap(t):
    options = t.lineitem.select("l_suppkey", "l_partkey").distinct().join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    named = options.select(F.col("l_suppkey").cast("string").alias("q"), F.lit(1).alias("beam"), F.col("l_partkey").alias("ord"), F.col("p_name").alias("key"), F.concat_ws(" ", "s_name", "p_type").alias("question"))
    return walk.cap_options(named, 10).select("q", "ord", "key")


@query("frontier_cap", GRAPH_SQL + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY node, rel, dir ORDER BY other) AS n FROM adj) SELECT node, rel, dir, other FROM ranked WHERE n <= 50")
def frontier_cap(t):
    return walk.cap_targets(star_graph(t).adjacency, ["node", "rel", "dir"], ["other"], 50).drop("n")


_NEAR_SQL = GRAPH_SQL + f""", asked AS (SELECT node, rel, dir, other, coalesce(o.name, other) AS name, 'parts almond with a ' || n.type || ' like ' || n.name AS question FROM adj JOIN nodes n ON n.id = node LEFT JOIN nodes o ON o.id = other),
near AS (SELECT *, len(list_intersect({_WORDS_SQL.format('question')}, {_WORDS_SQL.format('name')})) AS shared FROM asked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY node, rel, dir ORDER BY shared DESC, other) AS r FROM near)
SELECT node, rel, dir, other, row_number() OVER (PARTITION BY node, rel, dir ORDER BY other)::INTEGER AS n FROM ranked WHERE r <= """


@query("frontier_cap_near", _NEAR_SQL + "3")
def frontier_cap_near(t):
    """Each node's targets closest to a question about it."""
    g = star_graph(t)
    here = g.nodes.select(F.col("id").alias("node"), F.concat(F.lit("parts almond with a "), "type", F.lit(" like "), "name").alias("question"))
    names = g.nodes.select(F.col("id").alias("other"), "name")
    # the questions come last: what is dealt by the other node is moves alone, and the groups lie where their questions met them
    named = g.adjacency.join(names, "other", "left").withColumn("name", F.coalesce("name", "other"))
    return walk.cap_targets_near(named.join(here, "node"), ["node", "rel", "dir"], ["other"], 3).select("node", "rel", "dir", "other", "n")


@query("frontier_cap_hubs", GRAPH_SQL + ", ranked AS (SELECT rel, dir, node, other, row_number() OVER (PARTITION BY rel, dir ORDER BY node, other) AS n FROM adj) SELECT rel, dir, node, other, n::INTEGER AS n FROM ranked WHERE n <= 2000")
def frontier_cap_hubs(t):
    """Groups that hold a third of all moves, cut to more rows than Spark's own group limit serves."""
    return walk.cap_targets(star_graph(t).adjacency, ["rel", "dir"], ["node", "other"], 2000)


@query("token_estimate", "SELECT doc_id, ceil(length(text) / 3)::BIGINT AS tokens FROM documents")
def token_estimate(t):
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


# --- linking ------------------------------------------------------------------

def order_questions(t) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("q"), F.concat(F.lit("What did "), "c_name", F.lit(" of "), "n_name", F.lit(" order?")).alias("question"))


_ASK_SQL = "asked AS (SELECT c_custkey AS q, 'What did ' || c_name || ' of ' || n_name || ' order?' AS question FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in link.STOP_WORDS) + "]"
_PART_INDEX_SQL = "idx AS (SELECT DISTINCT 'p:' || p_partkey AS id, array_to_string(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+'), ' ') AS key FROM part WHERE length(p_name) >= 3)"
_POSTED_SQL = f"posted AS (SELECT id, key, unnest(list_filter(list_distinct(string_split(key, ' ')), lambda w: NOT list_contains({_STOPS_SQL}, w))) AS word FROM idx)"
_IDF_SQL = "idf AS (SELECT word, count(*) AS df, ln(1 + (SELECT count(*) FROM idx) / count(*)) AS idf FROM posted GROUP BY word)"


def part_index(t) -> DataFrame:
    return link.name_index(t.part.select(node_id("p", "p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("name_idf", f"WITH {_PART_INDEX_SQL}, {_POSTED_SQL}, {_IDF_SQL} SELECT word, df::BIGINT AS df, round(idf, 6) AS idf FROM idf")
def name_idf(t):
    return rounded(link.name_idf(part_index(t)))


@query("fuzzy_candidates", f"""WITH {_PART_INDEX_SQL}, {_POSTED_SQL}, {_IDF_SQL}, weighed AS (SELECT p.*, i.idf FROM posted p JOIN idf i USING (word)), totals AS (SELECT id, key, sum(idf) AS total FROM weighed GROUP BY ALL),
q AS (SELECT o_orderkey AS q, unnest(list_filter(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), '[\\p{{L}}\\p{{N}}_]+')), lambda w: NOT list_contains({_STOPS_SQL}, w))) AS word FROM (SELECT o.o_orderkey, p.p_name, p.p_brand FROM orders o JOIN part p ON p.p_partkey = o.o_custkey)),
matched AS (SELECT q, id, key, sum(idf) AS m FROM q JOIN weighed USING (word) GROUP BY ALL), best AS (SELECT q, id, max(m * m / total) AS score FROM matched JOIN totals USING (id, key) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM best) SELECT q, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 8""")
def fuzzy_candidates(t):
    asked = t.orders.join(t.part, F.col("o_custkey") == F.col("p_partkey")).select(F.col("o_orderkey").alias("q"), F.concat_ws(" ", "p_name", "p_brand").alias("question"))
    index = part_index(t)
    return rounded(link.fuzzy_candidates(asked, index, link.name_idf(index)))


@query("mention_ngrams", f"""WITH {_ASK_SQL}, w AS (SELECT q, regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+') AS w FROM asked), p AS (SELECT q, w, unnest(range(len(w))) AS pos FROM w), g AS (SELECT q, w, pos, unnest(range(1, least(12, len(w) - pos) + 1)) AS n FROM p)
SELECT q, pos::INTEGER AS pos, n::INTEGER AS n, array_to_string(w[pos + 1 : pos + n], ' ') AS key FROM g""")
def mention_ngrams(t):
    return link.ngrams(order_questions(t))


@query("exact_mentions")
def exact_mentions(t):
    names = star_graph(t).nodes.where("type in ('customer', 'nation')").select("id", "name")
    return link.exact_mentions(order_questions(t), link.name_index(names))


@query("linked_entries")
def linked_entries(t):
    return link.link(order_questions(t), star_graph(t).nodes.where("type in ('customer', 'nation')").select("id", "name"))


_SPOKEN_SQL = "' ' || trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' '"


@query("title_mentions", f"WITH {_ASK_SQL}, spoken AS (SELECT q, {_SPOKEN_SQL.format('question')} AS text FROM asked), titles AS (SELECT n_nationkey AS key, {_SPOKEN_SQL.format('n_name')} AS title FROM nation) SELECT DISTINCT q, key FROM spoken JOIN titles ON contains(text, title)")
def title_mentions(t):
    return locate.title_mentions(order_questions(t), t.nation.select(F.col("n_nationkey").alias("key"), F.concat("n_name", F.lit(" (nation)")).alias("title")))


# --- scores -------------------------------------------------------------------

@query("normalize_answers", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS answer FROM (SELECT p_partkey AS doc_id, 'The ' || p_name || ', a ' || p_type || '!' AS p_name FROM part)")
def normalize_answers(t):
    raw = F.concat(F.lit("The "), "p_name", F.lit(", a "), "p_type", F.lit("!"))
    return t.part.select(F.col("p_partkey").alias("doc_id"), X.normalize_answer(raw).alias("answer"))


def order_answers(t) -> DataFrame:
    """What an order contains, against the first half of its lines."""
    parts = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return parts.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.upper("p_name"))).alias("predicted"),
        F.array_sort(F.collect_list(F.when(F.col("l_linenumber") <= 2, F.col("p_name")))).alias("gold"),
    ).select(F.lit("lines").alias("system"), F.col("l_orderkey").alias("question_id"), "predicted", "gold")


_ANSWERS_SQL = """WITH sets AS (SELECT l_orderkey AS question_id, list_sort(list(DISTINCT lower(p_name))) AS p, coalesce(list(DISTINCT lower(p_name)) FILTER (l_linenumber <= 2), []) AS g FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
m AS (SELECT *, len(list_intersect(p, g)) AS hit FROM sets), r AS (SELECT *, CASE WHEN len(p) > 0 THEN hit / len(p) ELSE 0 END AS pr, CASE WHEN len(g) > 0 THEN hit / len(g) ELSE 0 END AS rc FROM m)
"""


@query("set_scores", _ANSWERS_SQL + """SELECT 'lines' AS system, question_id, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN hit > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1,
CASE WHEN len(p) = len(g) AND hit = len(g) THEN 1::DOUBLE ELSE 0::DOUBLE END AS em, CASE WHEN list_contains(g, p[1]) THEN 1::DOUBLE ELSE 0::DOUBLE END AS hits FROM r""")
def set_scores(t):
    return rounded(metrics.set_scores(order_answers(t)))


@query("token_f1", """WITH w AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part), l AS (SELECT id, unnest(a) AS word, 1 AS na, 0 AS nb FROM w UNION ALL SELECT id, unnest(b), 0, 1 FROM w),
c AS (SELECT id, word, sum(na) AS na, sum(nb) AS nb FROM l WHERE word NOT IN ('', 'a', 'an', 'the') GROUP BY ALL) SELECT id, round(CASE WHEN sum(least(na, nb)) = 0 THEN 0 ELSE 2 * sum(least(na, nb)) / (sum(na) + sum(nb)) END, 6)::DOUBLE AS f1 FROM c GROUP BY id""")
def token_f1(t):
    return rounded(metrics.token_f1(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("predicted"), F.col("p_type").alias("gold"))))


@query("run_summary", SCORES_SQL + """SELECT system, count(*)::BIGINT AS n, round(avg(f1), 6) AS f1, round(avg(em), 6) AS em, round(avg(hits), 6) AS hits, round(quantile_disc(latency, 0.5), 6) AS p50, round(quantile_disc(latency, 0.95), 6) AS p95,
round(avg(latency), 6) AS mean_latency, round(sum(cost), 6) AS cost, round(avg(calls), 6) AS calls, count(*) FILTER (status = 'ok')::BIGINT AS n_ok, count(*) FILTER (status = 'aborted')::BIGINT AS n_aborted, count(*) FILTER (status = 'error')::BIGINT AS n_error FROM scores GROUP BY system""")
def run_summary(t):
    return rounded(metrics.run_summary(scores(t)))


@query("scores_by_type", SCORES_SQL + "SELECT system, type, count(*)::BIGINT AS n, round(avg(f1), 6) AS f1, round(avg(em), 6) AS em FROM scores GROUP BY ALL")
def scores_by_type(t):
    return rounded(metrics.by_type(scores(t)))


@query("percentile_nearest_rank", SCORES_SQL + ", r AS (SELECT system, latency, row_number() OVER (PARTITION BY system ORDER BY latency) AS r, count(*) OVER (PARTITION BY system) AS n FROM scores) SELECT system, round(latency, 6) AS value FROM r WHERE r = greatest(1, ceil(n * 0.95))")
def percentile_nearest_rank(t):
    return rounded(metrics.nearest_rank(scores(t), ["system"], "latency", 95))


@query("percentile_by_index", SCORES_SQL + ", r AS (SELECT system, latency, row_number() OVER (PARTITION BY system ORDER BY latency) - 1 AS r, count(*) OVER (PARTITION BY system) AS n FROM scores) SELECT system, round(latency, 6) AS value FROM r WHERE r = least(n - 1, floor(n * 0.5))")
def percentile_by_index(t):
    return rounded(metrics.index_percentile(scores(t), ["system"], "latency", 0.5))


@query("absorbing_cost", SCORES_SQL + "SELECT system, type, CASE WHEN count(*) = count(cost) THEN round(sum(cost), 6) END AS cost, round(sum(cost), 6) AS reported FROM scores GROUP BY ALL")
def absorbing_cost(t):
    return rounded(scores(t).groupBy("system", "type").agg(metrics.absorbing_sum("cost").alias("cost"), F.sum("cost").alias("reported")))


@query("run_totals", "SELECT user_id AS run, count(value)::BIGINT AS calls, count(*)::BIGINT AS questions, sum(event_id)::BIGINT AS tokens, round(CASE WHEN count(event_id) = 0 THEN 0 ELSE sum(value) END, 6) AS cost FROM events GROUP BY user_id")
def run_totals(t):
    calls = t.events.select(F.col("user_id").alias("run"), F.lit(1).alias("questions"), F.col("event_id").alias("tokens"), F.col("value").alias("cost"))
    return rounded(metrics.run_totals(calls))


_BINS = ", binned AS (SELECT *, least(9, (SELECT count(*) FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) e(x) WHERE c >= x)) AS bin FROM sure)"


@query("reliability_bins", SCORES_SQL + _BINS + " SELECT system, bin::INTEGER AS bin, count(*)::BIGINT AS n, round(avg(c), 6) AS confidence, round(avg(y), 6) AS accuracy FROM binned GROUP BY ALL")
def reliability_bins(t):
    return rounded(metrics.reliability_bins(scores(t)))


@query("ece_bins", SCORES_SQL + _BINS + ", s AS (SELECT system, bin, count(*) AS n, sum(c) AS c, sum(y) AS y FROM binned GROUP BY ALL) SELECT system, round(sum(abs(c - y)) / sum(n), 6) AS ece FROM s GROUP BY system")
def ece_bins(t):
    return rounded(metrics.ece(scores(t)))


@query("brier", SCORES_SQL + "SELECT system, round(avg((c - y) * (c - y)), 6) AS brier FROM sure GROUP BY system")
def brier(t):
    return rounded(metrics.brier(scores(t)))


_AUROC = "auroc AS (SELECT a.system, sum(CASE WHEN a.c > b.c THEN 1::DOUBLE WHEN a.c = b.c THEN 0.5::DOUBLE ELSE 0 END * a.n * b.n) / sum(a.n * b.n) AS auroc FROM (SELECT system, c, count(*) AS n FROM sure WHERE y = 1 GROUP BY ALL) a JOIN (SELECT system, c, count(*) AS n FROM sure WHERE y = 0 GROUP BY ALL) b ON a.system = b.system GROUP BY a.system)"
_HALF = "half AS (SELECT system, avg(y) AS top_half FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY c DESC, question_id) AS k, count(*) OVER (PARTITION BY system) AS n FROM sure) WHERE k <= n // 2 GROUP BY system)"


@query("auroc", SCORES_SQL + f", {_AUROC} SELECT system, round(auroc, 6) AS auroc FROM auroc")
def auroc(t):
    return rounded(metrics.auroc(scores(t)))


@query("selective_accuracy", SCORES_SQL + f", {_HALF} SELECT system, round(top_half, 6) AS top_half FROM half")
def selective_accuracy(t):
    return rounded(metrics.selective_accuracy(scores(t)))


@query("calibration_row", SCORES_SQL + _BINS + f""", {_AUROC}, {_HALF}, s AS (SELECT system, bin, count(*) AS n, sum(c) AS c, sum(y) AS y FROM binned GROUP BY ALL), e AS (SELECT system, sum(abs(c - y)) / sum(n) AS ece FROM s GROUP BY system)
SELECT system, count(*)::BIGINT AS n, round(avg(c), 6) AS confidence, round(avg(y), 6) AS accuracy, round(any_value(ece), 6) AS ece, round(avg((c - y) * (c - y)), 6) AS brier, round(any_value(auroc), 6) AS auroc, round(any_value(top_half), 6) AS top_half
FROM sure JOIN e USING (system) JOIN auroc USING (system) JOIN half USING (system) GROUP BY system""")
def calibration_row(t):
    return rounded(metrics.calibration_row(scores(t)))


@query("aurc_curve", SCORES_SQL + """, k AS (SELECT system, y, row_number() OVER w AS k, sum(1 - y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wrong, count(*) OVER (PARTITION BY system) AS n, sum(y) OVER (PARTITION BY system) AS right FROM sure WINDOW w AS (PARTITION BY system ORDER BY c DESC, question_id))
SELECT system, round(avg(wrong / k), 6) AS aurc, round(avg(1 - y), 6) AS random, round(avg(greatest(0, k - "right") / k), 6) AS perfect, round(max(CASE WHEN k = greatest(1, floor(n * 0.25)) THEN 1 - wrong / k END), 6) AS acc_25,
round(max(CASE WHEN k = greatest(1, floor(n * 0.5)) THEN 1 - wrong / k END), 6) AS acc_50, round(max(CASE WHEN k = greatest(1, floor(n * 0.75)) THEN 1 - wrong / k END), 6) AS acc_75, round(max(CASE WHEN k = n THEN 1 - wrong / k END), 6) AS acc_100 FROM k GROUP BY system""")
def aurc_curve(t):
    return rounded(metrics.aurc(scores(t)))


@query("paired_difference", SCORES_SQL + "SELECT question_id, round(a.f1 - b.f1, 6) AS d FROM (SELECT * FROM scores WHERE system = 'walk') a JOIN (SELECT * FROM scores WHERE system = 'search') b USING (question_id)")
def paired_difference(t):
    return rounded(metrics.paired_difference(scores(t), "walk", "search"))


@query("escalation_simulation", SCORES_SQL + """, j AS (SELECT coalesce(a.confidence, 0) AS c, a.f1 AS f, b.f1 AS g, coalesce(a.cost, 0) AS cost, coalesce(b.cost, 0) AS more FROM (SELECT * FROM scores WHERE system = 'walk') a JOIN (SELECT * FROM scores WHERE system = 'search') b USING (question_id))
SELECT threshold, count(*)::BIGINT AS n, round(avg(CASE WHEN c < threshold THEN 1::DOUBLE ELSE 0 END), 6) AS escalated, round(avg(CASE WHEN c < threshold THEN g ELSE f END), 6) AS f1, round(sum(cost + CASE WHEN c < threshold THEN more ELSE 0 END), 6) AS cost
FROM j CROSS JOIN (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) x(threshold) GROUP BY threshold""")
def escalation_simulation(t):
    return rounded(metrics.escalation(scores(t), "walk", "search"))


@query("cost_break_even", """WITH c AS (SELECT s_suppkey AS a, s_nationkey AS b, abs(s_acctbal) AS fixed_a, (s_suppkey % 7) / 10 AS each_a, abs(s_acctbal) / 2 AS fixed_b, (s_suppkey % 5) / 10 AS each_b FROM supplier)
SELECT a, b, (CASE WHEN fixed_a - fixed_b <= 0 AND each_b - each_a >= 0 THEN 0 WHEN each_b - each_a <= 0 THEN -1 ELSE greatest(0, ceil((fixed_a - fixed_b) / (each_b - each_a))) END)::BIGINT AS queries FROM c""")
def cost_break_even(t):
    balance = F.abs("s_acctbal")
    costs = t.supplier.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("b"), balance.alias("fixed_a"), ((F.col("s_suppkey") % 7) / 10).alias("each_a"), (balance / 2).alias("fixed_b"), ((F.col("s_suppkey") % 5) / 10).alias("each_b"))
    return metrics.break_even(costs)


@query("spearman_confidence", SCORES_SQL + """, p AS (SELECT system, f1 AS x, coalesce(confidence, 0) AS y FROM scores), r AS (SELECT system, rank() OVER (PARTITION BY system ORDER BY x) + (count(*) OVER (PARTITION BY system, x) - 1) / 2 AS x, rank() OVER (PARTITION BY system ORDER BY y) + (count(*) OVER (PARTITION BY system, y) - 1) / 2 AS y FROM p)
SELECT system, round(corr(x, y), 6) AS rho FROM r GROUP BY system""")
def spearman_confidence(t):
    pairs = scores(t).select("system", F.col("f1").alias("x"), F.coalesce("confidence", F.lit(0.0)).alias("y"))
    return rounded(metrics.spearman(pairs, ["system"]))


@query("run_agreement", """WITH s AS (SELECT o_custkey AS question_id, o_orderkey AS run, o_orderstatus || o_orderpriority AS a FROM orders), c AS (SELECT question_id, a, count(*) AS n FROM s GROUP BY ALL)
SELECT question_id, round(max(n) / sum(n), 6)::DOUBLE AS agreement FROM c GROUP BY question_id""")
def run_agreement(t):
    return rounded(metrics.agreement(t.orders.select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("run"), F.array("o_orderpriority", "o_orderstatus").alias("answers"))))


@query("seed_spread", SCORES_SQL + ", m AS (SELECT system, seed, avg(f1) AS m FROM scores GROUP BY ALL) SELECT system, count(*)::BIGINT AS seeds, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd FROM m GROUP BY system")
def seed_spread(t):
    return rounded(metrics.seed_spread(scores(t)))


@query("no_decision_rescore", SCORES_SQL + "SELECT system, round(avg(CASE WHEN no_decision THEN 0.001 ELSE coalesce(confidence, 0) END), 6) AS confidence FROM scores GROUP BY system")
def no_decision_rescore(t):
    return rounded(metrics.rescored(scores(t)).groupBy("system").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("confidence")))


@query("bootstrap_ci")
def bootstrap_ci(t):
    return metrics.bootstrap_ci(scores(t), ["system"], "f1")


@query("paired_bootstrap")
def paired_bootstrap(t):
    return metrics.bootstrap_ci(metrics.paired_difference(scores(t), "walk", "search").withColumn("pair", F.lit("walk-search")), ["pair"], "d")


@query("platt_crossfit")
def platt_crossfit(t):
    return metrics.platt_scaled(scores(t)).drop("split", "half")


@query("platt_report")
def platt_report(t):
    return rounded(metrics.platt_report(scores(t)))


@query("ordered_union", "WITH f AS (SELECT o_custkey AS id, o_orderpriority AS label, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT id, string_agg(label, '|' ORDER BY first) AS labels FROM f GROUP BY id")
def ordered_labels(t):
    rows = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("ord"))
    return ordered_union(rows, ["id"], "label", "ord", "labels").select("id", F.array_join("labels", "|").alias("labels"))


@query("walkable_edges", GRAPH_SQL + "SELECT source, type, target FROM edges WHERE type IN ('lives_in', 'based_in')")
def walkable_edges(t):
    g = star_graph(t)
    evidence = F.array(F.when(F.col("type") != "in_region", F.col("source")))
    return Graph(g.nodes, g.edges.withColumn("evidence", F.array_compact(evidence))).walkable(["lives_in", "based_in", "in_region"]).edges.select("source", "type", "target")


@query("get_edges", GRAPH_SQL + ", ids AS (SELECT 'e:' || substr(sha256(source || chr(31) || type || chr(31) || target), 1, 32) AS id, * FROM edges WHERE type = 'in_region') SELECT id, source, type, target FROM ids")
def get_edges(t):
    g = star_graph(t)
    wanted = g.edges.where("type = 'in_region'").select(X.edge_id(F.col("source"), F.col("type"), F.col("target")).alias("id"))
    return g.get_edges(wanted)


@query("router_logistic")
def router_logistic(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 150000).cast("int").alias("y"), F.log1p("o_totalprice").alias("price"), F.length("o_orderpriority").cast("double").alias("words"))
    return metrics.logistic_scores(rows, ["price", "words"])


# --- retrieval ----------------------------------------------------------------

@query("dense_topk", """WITH s AS (SELECT q.vec_id AS q, v.vec_id AS key, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key)::INTEGER AS rank FROM s) SELECT q, key, round(score, 5) AS score, rank FROM r WHERE rank <= 10""")
def dense_topk(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return rounded(locate.dense_top_k(asked, vectors, 10), 5)


def order_rankings(t) -> DataFrame:
    """Two rankings of each order's parts, by price and by quantity."""
    price = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")
    many = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey")
    rows = t.lineitem.select("l_orderkey", "l_partkey", F.row_number().over(price).alias("by_price"), F.row_number().over(many).alias("by_quantity"))
    both = F.explode(F.array(F.struct(F.lit("price").alias("method"), F.col("by_price").alias("rank")), F.struct(F.lit("quantity").alias("method"), F.col("by_quantity").alias("rank"))))
    return rows.select(F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("key"), both.alias("r")).select("question_id", "r.method", "r.rank", "key")


_RANKINGS_SQL = """WITH b AS (SELECT l_orderkey AS question_id, l_partkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS bp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS bq FROM lineitem),
rankings AS (SELECT question_id, 'price' AS method, bp AS rank, key FROM b UNION ALL SELECT question_id, 'quantity', bq, key FROM b),
best AS (SELECT question_id, method, key, min(rank) AS rank FROM rankings GROUP BY ALL)
"""


@query("rrf_keys", _RANKINGS_SQL + ", f AS (SELECT question_id, key, sum(1 / (60 + rank)) AS score FROM best GROUP BY ALL) SELECT question_id, key, round(score, 9) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, key)::INTEGER AS rank FROM f")
def rrf_keys(t):
    return rounded(metrics.reciprocal_rank_fusion(order_rankings(t)), 9)


@query("first_per_document", "WITH c AS (SELECT o_custkey AS question_id, l_partkey AS key, l_orderkey * 10 + l_linenumber AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey), m AS (SELECT question_id, key, min(rank) AS best FROM c GROUP BY ALL) SELECT question_id, key, row_number() OVER (PARTITION BY question_id ORDER BY best, key)::INTEGER AS rank FROM m")
def first_per_document(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("question_id"), F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"))
    return metrics.first_per_document(rows)


@query("recall_at_k", _RANKINGS_SQL + """, placed AS (SELECT *, row_number() OVER (PARTITION BY method, question_id ORDER BY rank, key) AS n FROM best), gold AS (SELECT DISTINCT l_orderkey AS question_id, l_partkey AS key FROM lineitem WHERE l_returnflag = 'R'),
hit AS (SELECT q.method, g.question_id, avg(CASE WHEN p.n <= 2 THEN 1::DOUBLE ELSE 0 END) AS recall, min(CASE WHEN p.n <= 2 THEN 1::DOUBLE ELSE 0 END) AS complete FROM gold g JOIN (SELECT DISTINCT method, question_id FROM rankings) q USING (question_id) LEFT JOIN placed p ON p.method = q.method AND p.question_id = g.question_id AND p.key = g.key GROUP BY ALL)
SELECT method, count(*)::BIGINT AS n, round(avg(recall), 6) AS recall, round(avg(complete), 6) AS complete FROM hit GROUP BY method""")
def recall_at_k(t):
    gold = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("key"))
    return rounded(metrics.recall_at(order_rankings(t), gold, 2))


def document_spans(t) -> DataFrame:
    """Each conversation's turns as overlapping spans of one text: two lists of them."""
    base = t.conversations.select(F.col("conv_id").alias("q"), F.col("conv_id").cast("string").alias("key"), F.col("turn"), F.length("text").alias("n"))
    return base.select("q", F.explode(F.array(F.lit(0), F.lit(1))).alias("list"), F.col("turn").cast("int").alias("rank"), "key", (F.col("turn") * 100).cast("int").alias("start"), (F.col("turn") * 100 + F.col("n")).cast("int").alias("end"))


@query("rrf_overlap")
def rrf_overlap(t):
    return locate.fuse_spans(document_spans(t), 10)


@query("locate_select")
def locate_select(t):
    return locate.select_spans(document_spans(t).where("list = 0"), 10)


@query("chunk_spans")
def chunk_spans(t):
    return locate.chunked(t.documents.select(F.col("doc_id").alias("key"), "text")).select("key", "chunk", F.size("pieces").alias("n_pieces"), F.length("text").alias("n_chars"))


@query("dense_locate")
def dense_locate(t):
    asked = t.benchmark.select(F.col("item_id").alias("q"), F.col("text").alias("question"))
    return locate.locate_dense(asked, t.documents.select(F.col("doc_id").alias("key"), "text"), 5)


def evidence_pairs(t, quote) -> DataFrame:
    """Documents and the passages that may stand in them, with both texts."""
    pairs = locate.quote_pairs(t.documents.select(F.col("doc_id").alias("key"), "text"), t.benchmark.select(F.col("item_id").alias("item"), quote.alias("quote")))
    return pairs.withColumnsRenamed({"key": "doc_id", "item": "item_id"}).join(t.documents.select("doc_id", "text"), "doc_id").join(t.benchmark.withColumnRenamed("text", "quote"), "item_id")


@query("evidence_exact", "SELECT d.doc_id, b.item_id, instr(d.text, b.text)::INTEGER - 1 AS start FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def evidence_exact(t):
    pairs = evidence_pairs(t, F.col("text"))
    return pairs.select("doc_id", "item_id", locate.evidence_start(F.col("text"), F.col("quote")).alias("start")).where("start is not null")


@query("find_evidence_folded")
def find_evidence_folded(t):
    pairs = evidence_pairs(t, locate.bare_quote("text"))
    return pairs.select("doc_id", "item_id", locate.find_evidence("text", "quote").alias("span")).select("doc_id", "item_id", "span.start", "span.end")


@query("read_span", "SELECT l.doc_id AS q, d.doc_id AS key, greatest(0, least(10, length(text)) - 5)::INTEGER AS start, least(length(text), 45)::INTEGER AS \"end\", substr(text, greatest(0, least(10, length(text)) - 5) + 1, least(length(text), 45) - greatest(0, least(10, length(text)) - 5)) AS passage, l.quality = 0 AS stale FROM labels l JOIN documents d USING (doc_id)")
def read_span(t):
    docs = t.documents.select(F.col("doc_id").alias("key"), "text")
    seen = t.labels.join(t.documents, "doc_id").select(F.col("doc_id").alias("q"), F.col("doc_id").alias("key"), F.lit(10).alias("start"), F.lit(40).alias("end"), F.when(F.col("quality") == 0, F.lit("sha256:other")).otherwise(X.content_hash(F.col("text"))).alias("seen_hash"))
    return locate.read_spans(seen, docs, 5).drop("snippet")


@query("ledger_diff", "SELECT 'd:' || d.doc_id AS key, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT 'b:' || item_id, 'removed' FROM benchmark")
def ledger_diff(t):
    now = t.documents.select(node_id("d", "doc_id").alias("key"), X.content_hash(F.col("text")).alias("hash"))
    was = now.join(t.labels.select(node_id("d", "doc_id").alias("key"), "quality"), "key").select("key", F.when(F.col("quality") == 0, "old").otherwise(F.col("hash")).alias("hash"))
    gone = t.benchmark.select(node_id("b", "item_id").alias("key"), X.content_hash(F.col("text")).alias("hash"))
    return ingest.ledger_diff(now, was.unionByName(gone))


# --- changes ------------------------------------------------------------------

def same_name_parts(t) -> DataFrame:
    """Parts of one name: all but the smallest id are absorbed by it."""
    own = Window.partitionBy("p_name")
    rows = t.part.select(node_id("p", "p_partkey").alias("absorbed"), F.min(node_id("p", "p_partkey")).over(own).alias("keep"))
    return rows.where("absorbed <> keep")


_SAME_SQL = ", same AS (SELECT absorbed, keep FROM (SELECT 'p:' || p_partkey AS absorbed, min('p:' || p_partkey) OVER (PARTITION BY p_name) AS keep FROM part) WHERE absorbed <> keep)"


@query("rewire_edges", GRAPH_SQL + _SAME_SQL + """SELECT coalesce(a.keep, source) AS source, type, coalesce(b.keep, target) AS target, count(*)::BIGINT AS n FROM edges LEFT JOIN same a ON a.absorbed = source LEFT JOIN same b ON b.absorbed = target
WHERE coalesce(a.keep, source) <> coalesce(b.keep, target) OR source = target GROUP BY ALL""")
def rewire_edges(t):
    return mutate.rewired(star_graph(t).edges.withColumn("n", F.lit(1).cast("long")), same_name_parts(t))


def part_attributes(t) -> DataFrame:
    """Brand, type and size of parts under their name's first id; the brand counts as the source."""
    own = Window.partitionBy("p_name")
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (("brand", "p_brand"), ("type", "p_type"), ("size", "p_size")))))
    return t.part.select(F.min(node_id("p", "p_partkey")).over(own).alias("id"), values.alias("v"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("source_id")).select("id", "v.key", "v.value", "ord", "source_id")


_ATTR_SQL = """WITH base AS (SELECT min('p:' || p_partkey) OVER (PARTITION BY p_name) AS id, p_partkey AS ord, p_brand, p_type, p_size FROM part), attrs AS (SELECT id, 'brand' AS key, p_brand AS value, ord, p_brand AS source_id FROM base
UNION ALL SELECT id, 'type', p_type, ord, p_brand FROM base UNION ALL SELECT id, 'size', p_size::VARCHAR, ord, p_brand FROM base)
, sources AS (SELECT id, key, value, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources FROM attrs GROUP BY ALL)
"""


@query("merge_fold", _ATTR_SQL + ", kept AS (SELECT id, key, arg_min(value, ord) AS value FROM attrs GROUP BY ALL) SELECT id, key, value, sources FROM kept JOIN sources USING (id, key, value)")
def merge_fold(t):
    return mutate.fold(part_attributes(t))[0].select("id", "key", "value", F.array_join("sources", ",").alias("sources"))


@query("conflicts", _ATTR_SQL + "SELECT id, key, value, sources FROM sources JOIN (SELECT id, key FROM attrs GROUP BY ALL HAVING count(DISTINCT value) > 1) USING (id, key)")
def conflicts(t):
    return mutate.fold(part_attributes(t))[1].select("id", "key", "value", F.array_join("sources", ",").alias("sources"))


@query("retract_source", "SELECT 'o:' || l_orderkey AS element FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_returnflag <> 'R') = 0")
def retract_source(t):
    provenance = t.lineitem.select(node_id("o", "l_orderkey").alias("element"), F.col("l_returnflag").alias("source_id"))
    gone = provenance.select("source_id").distinct().where("source_id = 'R'")
    return mutate.retract(provenance, part_attributes(t), gone)[0]


@query("retract_attributes", _ATTR_SQL + ", dearest AS (SELECT max(p_brand) AS b FROM part), left_ AS (SELECT id, key, arg_min(value, ord) AS value FROM attrs WHERE source_id <> (SELECT b FROM dearest) GROUP BY ALL) SELECT id, key, value FROM left_")
def retract_attributes(t):
    gone = t.part.agg(F.max("p_brand").alias("source_id"))
    provenance = part_attributes(t).select(F.col("id").alias("element"), "source_id")
    return mutate.retract(provenance, part_attributes(t), gone)[1].select("id", "key", "value")


_RENAMES = (("supplied_by", "supplies", True), ("placed_by", "buyer", False), ("based_in", "located_in", False), ("lives_in", "located_in", False))


@query("relation_rewrite", GRAPH_SQL + """, named AS (SELECT CASE WHEN type = 'supplied_by' THEN target ELSE source END AS source, CASE type WHEN 'supplied_by' THEN 'supplies' WHEN 'placed_by' THEN 'buyer' WHEN 'based_in' THEN 'located_in' WHEN 'lives_in' THEN 'located_in' ELSE type END AS type,
CASE WHEN type = 'supplied_by' THEN source ELSE target END AS target FROM edges) SELECT source, type, target, count(*)::BIGINT AS n, 'e:' || substr(sha256(source || chr(31) || type || chr(31) || target), 1, 32) AS id FROM named GROUP BY ALL""")
def relation_rewrite(t):
    mapping = t.spark.createDataFrame(list(_RENAMES), "type string, new_type string, reversed boolean")
    return mutate.rename_relations(star_graph(t).edges.withColumn("n", F.lit(1).cast("long")), mapping)


@query("attribute_edges", "SELECT DISTINCT 'c:' || c_custkey AS source, 'home' AS type, 'n:' || n_nationkey AS target FROM customer JOIN nation ON c_nationkey = n_nationkey")
def attribute_edges(t):
    g = star_graph(t)
    values = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(node_id("c", "c_custkey").alias("id"), F.lit("home").alias("key"), F.col("n_name").alias("value"))
    return mutate.attribute_edges(values, g.names, g.edges)


def customer_chains(t) -> DataFrame:
    """Each customer is merged into the one before, in chains of eight, the last ones first."""
    k = F.col("c_custkey")
    return t.customer.where(k % 8 != 0).select(node_id("c", "c_custkey").alias("absorbed"), F.concat(F.lit("c:"), (k - 1).cast("string")).alias("keep"), (-k).alias("ord"))


_CHAIN_SQL = GRAPH_SQL + ", heads AS (SELECT id, id AS own, CASE WHEN type = 'customer' THEN 'c:' || (substr(id, 3)::BIGINT - substr(id, 3)::BIGINT % 8) ELSE id END AS head FROM nodes)\n"


@query("merge_chain_edges", _CHAIN_SQL + """SELECT coalesce(a.head, source) AS source, type, coalesce(b.head, target) AS target, count(*)::BIGINT AS n FROM edges LEFT JOIN heads a ON a.id = source LEFT JOIN heads b ON b.id = target
WHERE coalesce(a.head, source) <> coalesce(b.head, target) OR source = target GROUP BY ALL""")
def merge_chain_edges(t):
    return merge.merged_edges(star_graph(t).edges.withColumn("n", F.lit(1)), merge.resolved(customer_chains(t)))


@query("merge_chain_nodes", _CHAIN_SQL + """SELECT head AS id, any_value(n.type) AS type, arg_min(n.name, length(id) * 1e9 + CASE WHEN n.type = 'customer' THEN substr(id, 3)::BIGINT ELSE 0 END) AS name,
string_agg(n.name, ',' ORDER BY substr(id, 3)::BIGINT) FILTER (id <> head) AS aliases FROM nodes n JOIN heads USING (id) WHERE n.type IN ('customer', 'nation') GROUP BY head""")
def merge_chain_nodes(t):
    nodes = star_graph(t).nodes.where("type in ('customer', 'nation')").select("*", F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("summary"))
    found, _ = merge.merged_nodes(nodes, merge.resolved(customer_chains(t)))
    return found.select("id", "type", "name", F.nullif(F.array_join("aliases", ","), F.lit("")).alias("aliases"))


@query("removal_cascade", GRAPH_SQL + """, gone AS (SELECT id FROM nodes WHERE type = 'supplier'), named AS (SELECT * FROM edges WHERE type = 'based_in')
SELECT (SELECT count(*) FROM gone) AS n_nodes, (SELECT count(*) FROM named) AS n_edges,
(SELECT count(*) FROM edges WHERE type <> 'based_in' AND (source IN (SELECT id FROM gone) OR target IN (SELECT id FROM gone))) AS n_touching""")
def removal_cascade(t):
    g = star_graph(t)
    return merge.cascade(g, g.nodes.where("type = 'supplier'"), g.edges.where("type = 'based_in'"))


@query("delete_cascade", GRAPH_SQL + "SELECT type, count(*)::BIGINT AS n FROM edges WHERE source NOT LIKE 's:%' AND target NOT LIKE 's:%' GROUP BY type")
def delete_cascade(t):
    g = star_graph(t)
    return mutate.delete_nodes(g, g.nodes.where("type = 'supplier'").select("id")).edges.groupBy("type").agg(F.count("*").alias("n"))


@query("upsert_last", "WITH new AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id)::BIGINT AS event_id FROM events WHERE event_id % 3 > 0 AND user_id % 2 = 0 GROUP BY user_id), old AS (SELECT user_id, 'old' AS event_type, min(event_id)::BIGINT AS event_id FROM events GROUP BY user_id) SELECT * FROM new UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new)")
def upsert_last(t):
    new = t.events.where("event_id % 3 > 0 and user_id % 2 = 0").select("user_id", "event_type", "event_id", F.col("event_id").alias("ord"))
    old = t.events.groupBy("user_id").agg(F.lit("old").alias("event_type"), F.min("event_id").alias("event_id"))
    return mutate.upsert(old, new, ["user_id"])


@query("triple_recall", """SELECT c_custkey AS question_id, lower(c_name) AS source, lower(n_name) AS target, true AS found FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT c_custkey, lower(c_name), lower(r_name), false FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def triple_recall(t):
    home = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    gold = home.select(F.col("c_custkey").alias("question_id"), F.lower("c_name").alias("source"), F.explode(F.array(F.lower("n_name"), F.lower("r_name"))).alias("target"))
    g = star_graph(t)
    return ingest.triple_recall(gold, g.names, g.edges)


@query("chain_recall", "SELECT c_custkey AS question_id, 0.5::DOUBLE AS recall, false AS complete FROM customer")
def chain_recall(t):
    return ingest.chain_recall(triple_recall(t))


@query("route_by_name", "SELECT 'd:' || c_custkey AS document, lower(n_name) AS key, n_name AS name, 'nation' AS type, 'n:' || n_nationkey AS node, false AS created FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'd:' || c_custkey, lower(c_mktsegment), c_mktsegment, 'segment', 'n:' || substr(sha256('d:' || c_custkey || chr(31) || lower(c_mktsegment) || chr(31) || 'segment'), 1, 24), true FROM customer")
def route_by_name(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    both = F.explode(F.array(F.struct(F.col("n_name").alias("name"), F.lit("nation").alias("type")), F.struct(F.col("c_mktsegment").alias("name"), F.lit("segment").alias("type"))))
    mentions = rows.select(node_id("d", "c_custkey").alias("document"), both.alias("m")).select("document", F.lower("m.name").alias("key"), "m.name", "m.type")
    return ingest.route_by_name(mentions, star_graph(t).names)


@query("routing_candidates")
def routing_candidates(t):
    mentions = t.part.select(F.col("p_partkey").alias("m"), F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("key"))
    return ingest.routing_candidates(mentions, star_graph(t).names.where("id like 's:%' or id like 'n:%' or id like 'p:%'"))


@query("completed_documents", "SELECT l_orderkey AS document, bool_and(l_linestatus = 'F') AS done, count(*)::BIGINT AS chunks FROM lineitem GROUP BY l_orderkey")
def completed_documents(t):
    return ingest.completed(t.lineitem.select(F.col("l_orderkey").alias("document"), (F.col("l_linestatus") == "F").alias("applied")))


@query("relation_examples", GRAPH_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY source, target) AS i, count(*) OVER (PARTITION BY type) AS n FROM edges) SELECT type, n::BIGINT AS n, string_agg(source || ' -> ' || target, '; ' ORDER BY i) AS examples FROM r WHERE i <= 3 GROUP BY ALL")
def relation_examples(t):
    return ingest.relation_examples(star_graph(t).edges).select("type", "n", F.array_join("examples", "; ").alias("examples"))


# --- texts --------------------------------------------------------------------

@query("document_idf", "WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS word FROM documents) SELECT word, count(*)::BIGINT AS df, round(ln(1 + (SELECT count(*) FROM documents) / count(*)), 6) AS idf FROM w GROUP BY word")
def document_idf(t):
    return rounded(metrics.idf(t.documents.select(F.col("doc_id").alias("id"), "text")))


@query("content_hashes", "SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
def content_hashes(t):
    return t.documents.select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query("snippets", "WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) <= 240 THEN s ELSE substr(s, 1, 239) || '…' END AS snippet FROM f")
def snippets(t):
    return t.documents.select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("snake_names", "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^0-9a-z]+', '_', 'g'), '_') AS name FROM part")
def snake_names(t):
    return t.part.select("p_partkey", X.snake(F.col("p_type")).alias("name"))


@query("canonical_properties")
def canonical_properties(t):
    return t.events.select("event_id", X.canonical_json("props").alias("props"))


@query("question_features", f"""WITH {_ASK_SQL} SELECT q, len(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+'))::BIGINT AS n_words, regexp_extract(lower(question), '\\b(who|what|when|where|which|why|how)\\b', 1) AS wh_word,
{", ".join(f"regexp_matches(lower(question), '{p}')::INTEGER AS {c}" for c, p in X.CUES.items())} FROM asked""")
def question_features(t):
    return order_questions(t).select("q", *X.question_features(F.col("question")))


@query("rendered_edges", GRAPH_SQL + "SELECT source || ' --' || type || '--> ' || target AS edge FROM edges")
def rendered_edges(t):
    return star_graph(t).edges.select(X.arrow(F.col("source"), F.col("type"), F.col("target")).alias("edge"))


@query("entity_documents", GRAPH_SQL + """, r AS (SELECT a.node, a.rel, a.dir, n.name, row_number() OVER (PARTITION BY a.node ORDER BY a.dir <> 'out', a.rel, a.other) AS i FROM adj a JOIN nodes n ON n.id = a.other WHERE a.node LIKE 's:%' OR a.node LIKE 'n:%')
SELECT node, string_agg(rel || ' ' || dir || ' ' || name, '; ' ORDER BY i) AS facts FROM r WHERE i <= 40 GROUP BY node""")
def entity_documents(t):
    g = star_graph(t)
    near = g.neighbors(g.nodes.where("type in ('supplier', 'nation')").select(F.col("id").alias("node"))).where("position <= 40")
    fact = F.struct("position", F.concat_ws(" ", "rel", "dir", "other_name").alias("f"))
    return near.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(fact)), lambda x: x["f"]), "; ").alias("facts"))


@query("triple_passages", GRAPH_SQL + """, r AS (SELECT e.*, a.name AS sn, b.name AS tn, row_number() OVER (PARTITION BY source ORDER BY e.type, target) AS i FROM edges e JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target)
SELECT source AS subject, string_agg(sn || ' ' || replace(type, '_', ' ') || ' ' || tn || '.', ' ' ORDER BY i) AS passage FROM r WHERE i <= 30 GROUP BY source""")
def triple_passages(t):
    return triple_io.triple_passages(triples(t), star_graph(t).nodes)


@query("anonymised_triples", GRAPH_SQL + "SELECT DISTINCT 'Entity ' || substr(sha256('s' || chr(31) || source), 1, 6) AS subject, type AS relation, 'Entity ' || substr(sha256('s' || chr(31) || target), 1, 6) AS object FROM edges")
def anonymised_triples(t):
    return datasets.anonymised(triples(t, distinct=True), "s")[0].distinct()


@query("anonymised_questions", f"""WITH {_ASK_SQL}, named AS (SELECT a.q, a.question, c.c_name AS c, n.n_name AS n FROM asked a JOIN customer c ON c.c_custkey = a.q JOIN nation n ON n.n_nationkey = c.c_nationkey),
alias AS (SELECT *, 'Entity ' || substr(sha256('s' || chr(31) || c), 1, 6) AS ca, 'Entity ' || substr(sha256('s' || chr(31) || n), 1, 6) AS na FROM named)
SELECT q, replace(replace(question, c, ca), n, na) AS question, ca AS topic, true AS topic_in_question FROM alias""")
def anonymised_questions(t):
    asked = order_questions(t).join(t.customer.select(F.col("c_custkey").alias("q"), F.array("c_name").alias("start")), "q")
    names = t.customer.select(F.col("c_name").alias("name")).union(t.nation.select("n_name"))
    return datasets.anonymised_questions(asked, names, "s").select("q", "question", F.get("start", F.lit(0)).alias("topic"), "topic_in_question")


# --- decisions and reports ----------------------------------------------------

@query("opaque_labels", "WITH o AS (SELECT DISTINCT l_suppkey::VARCHAR AS q, l_partkey AS ord FROM lineitem) SELECT q, ord, 'o' || row_number() OVER (PARTITION BY q ORDER BY ord) AS label FROM o")
def opaque_labels(t):
    return options.opaque_labels(supplier_options(t)).select("q", "ord", "label")


@query("readable_labels", "WITH o AS (SELECT DISTINCT l_suppkey::VARCHAR AS q, l_partkey AS ord FROM lineitem), n AS (SELECT q, ord, p_name, row_number() OVER (PARTITION BY q, p_name ORDER BY ord) AS n FROM o JOIN part ON p_partkey = ord) SELECT q, ord, CASE WHEN n > 1 THEN p_name || ' #' || n ELSE p_name END AS label FROM n")
def readable_labels(t):
    named = supplier_options(t).drop("key").join(t.part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("key")), "ord")
    return options.readable_labels(named.withColumn("rel", F.lit("supplied_by"))).select("q", "ord", "label")


@query("cap_by_similarity", """WITH s AS (SELECT a.label::VARCHAR AS q, a.vec_id AS ord, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) b USING (label)),
r AS (SELECT *, count(*) OVER (PARTITION BY q) AS n, row_number() OVER (PARTITION BY q ORDER BY s DESC, ord) AS r FROM s) SELECT q, ord, round(s, 5) AS similarity FROM r WHERE r <= CASE WHEN n > 50 THEN 30 ELSE 255 END""")
def cap_by_similarity(t):
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("qv"))
    rows = t.embeddings.join(first, "label").select(F.col("label").cast("string").alias("q"), F.lit(1).alias("beam"), F.col("vec_id").alias("ord"), F.col("embedding").alias("v"), "qv")
    return rounded(options.cap_by_similarity(rows)[0].select("q", "ord", "similarity"), 5)


@query("stop_gate", GRAPH_SQL + "SELECT id AS q, CASE WHEN type = 'order' THEN 2 ELSE 1 END::BIGINT AS options FROM nodes WHERE type IN ('order', 'customer')")
def stop_gate(t):
    nodes_ = star_graph(t).nodes.where("type in ('order', 'customer')").select(F.col("id").alias("q"), F.lit(1).alias("beam"), "type")
    asked = nodes_.select("q", "beam", F.explode(F.array(F.lit("contains"), F.lit(decide.STOP))).alias("key"))
    predicted = nodes_.select("q", F.lit("order").alias("type"), F.lit(0.9).alias("p"))
    return options.gate_stop(asked, nodes_, predicted).groupBy("q").agg(F.count("*").alias("options"))


@query("logprob_options", """WITH o AS (SELECT l_orderkey::VARCHAR AS q, l_partkey AS ord, sum(exp(-l_quantity / 10)) AS m FROM lineitem GROUP BY ALL), w AS (SELECT *, greatest(m, 0.000001) AS w FROM o) SELECT q, ord, round(w / sum(w) OVER (PARTITION BY q), 6) AS p FROM w""")
def logprob_options(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("q"), F.col("l_partkey").alias("ord")).agg(F.collect_list(-F.col("l_quantity") / 10).alias("logprobs")).withColumn("beam", F.lit(1))
    return rounded(options.from_logprobs(rows).select("q", "ord", "p"))


@query("stated_scores", "WITH o AS (SELECT l_orderkey::VARCHAR AS q, l_partkey::VARCHAR AS label, max(l_quantity) AS w FROM lineitem GROUP BY ALL) SELECT q, label, round(w / sum(w) OVER (PARTITION BY q), 6) AS p FROM o")
def stated_scores(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("q"), F.col("l_partkey").cast("string").alias("label")).agg(F.max("l_quantity").alias("s"))
    reply = F.concat(F.lit('Scores: {"'), "label", F.lit('": '), F.col("s").cast("string"), F.lit("} as asked"))
    return rounded(options.from_stated_scores(rows.select("q", F.lit(1).alias("beam"), F.lit(1).alias("ord"), "label", reply.alias("reply"))).select("q", "label", "p"))


@query("voted_options", "WITH v AS (SELECT user_id::VARCHAR AS q, event_type AS label, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT q, label FROM (SELECT DISTINCT user_id::VARCHAR AS q FROM events), (SELECT DISTINCT event_type AS label FROM events)), w AS (SELECT o.q, o.label, coalesce(n, 0) + 0.1::DOUBLE AS w FROM o LEFT JOIN v ON v.q = o.q AND v.label = o.label) SELECT q, label, round(w / sum(w) OVER (PARTITION BY q), 6) AS p FROM w")
def voted_options(t):
    votes = t.events.select(F.col("user_id").cast("string").alias("q"), F.lit(1).alias("beam"), F.col("event_type").alias("label"))
    kinds = F.broadcast(votes.select("label").distinct())  # the event types, a handful
    asked = votes.select("q", "beam").distinct().crossJoin(kinds)
    return rounded(options.from_votes(votes, asked).select("q", "label", "p"))


@query("entity_recall", """WITH gold AS (SELECT DISTINCT c_custkey AS question_id, lower(n_name) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT p_partkey, lower(p_name) FROM part UNION SELECT c_custkey, lower(c_mktsegment) FROM customer),
names AS (SELECT 'n:' || n_nationkey AS id, lower(n_name) AS key FROM nation UNION SELECT 'p:' || p_partkey, lower(p_name) FROM part), h AS (SELECT name, count(DISTINCT id) AS nodes FROM (SELECT DISTINCT name FROM gold) LEFT JOIN names ON key = name GROUP BY name)
SELECT count(*)::BIGINT AS gold, count(*) FILTER (nodes > 0)::BIGINT AS found, count(*) FILTER (nodes > 1)::BIGINT AS split, 0::BIGINT AS over_merged, round(count(*) FILTER (nodes > 0) / count(*), 6) AS recall FROM h""")
def entity_recall(t):
    home = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    gold = home.select(F.col("c_custkey").alias("question_id"), F.explode(F.array(F.lower("n_name"), F.lower("c_mktsegment"))).alias("name")).unionByName(t.part.select(F.col("p_partkey").alias("question_id"), F.lower("p_name").alias("name")))
    return rounded(reports.entity_recall(gold, star_graph(t).names.where("id like 'n:%' or id like 'p:%'")))


@query("ingest_counters", "SELECT event_type AS kind, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS documents FROM events GROUP BY event_type")
def ingest_counters(t):
    return reports.ingest_counters(t.events.select(F.col("user_id").alias("document"), F.col("event_type").alias("kind")))


def scripted_replies(asked: DataFrame) -> DataFrame:
    """An extractor that fails now and then: every third length at first, every seventh always."""
    n = F.length("text")
    reply = F.when(n % 7 == 0, "no idea").when((n % 3 == 0) & F.col("error").isNull(), '{"entities": 5}').otherwise('Here: {"entities": [], "relations": []}')
    return asked.select("chunk", reply.alias("reply"))


@query("resumed_extraction", "SELECT doc_id AS chunk, CASE WHEN length(t) % 7 = 0 OR length(t) % 3 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN length(t) % 7 = 0 THEN 'no object' END AS error FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def resumed_extraction(t):
    """The first of several windows, then a second run that takes up the rest."""
    chunks, folder = t.documents.select(F.col("doc_id").alias("chunk"), "text"), scratch_path(t.documents.sparkSession, "replies")
    size = max(1, chunks.count() // 3)
    reply_store.extracted(chunks, scripted_replies, folder, size=size, windows=1)
    return reply_store.extracted(chunks, scripted_replies, folder, size=size).select("chunk", "attempts", "error")


@query("agent_table", "WITH r AS (SELECT o_orderpriority AS arm, o_orderkey, count(*) AS n, sum(l_quantity) AS tokens, sum(l_extendedprice) AS cost, avg(l_discount) AS f1, bool_or(l_returnflag = 'R') AS grounded FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) SELECT arm, count(*)::BIGINT AS n, round(avg(n), 4) AS turns, round(avg(tokens), 4) AS tokens, round(avg(cost), 4) AS cost, round(avg(f1), 4) AS f1, round(avg(CASE WHEN grounded THEN 1::DOUBLE ELSE 0 END), 4) AS grounded, round(avg(n), 4) AS tool_calls FROM r GROUP BY arm")
def agent_table(t):
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    turns = rows.groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_orderkey").alias("question_id")).agg(F.count("*").alias("turns"), F.sum("l_quantity").alias("tokens"), F.sum("l_extendedprice").alias("cost"), F.avg("l_discount").alias("f1"), F.bool_or(F.col("l_returnflag") == "R").alias("grounded"), F.collect_list("l_shipdate").alias("tools"))
    return rounded(reports.agent_table(turns), 4)


@query("groundedness", "SELECT doc_id AS question_id, CASE WHEN contains(lower(text), lower(lang)) THEN 1::DOUBLE ELSE 0::DOUBLE END AS grounded FROM documents")
def groundedness(t):
    return reports.groundedness(t.documents.select(F.col("doc_id").alias("question_id"), F.col("lang").alias("answer"), F.col("text").alias("output")))


@query("stratified_sample")
def stratified_sample(t):
    return reports.seeded_sample(t.documents.select("doc_id", "lang"), 20, "doc_id", 7, ["lang"])


@query("loose_accuracy")
def loose_accuracy(t):
    return t.part.select("p_partkey", reports.loose_accuracy(F.concat_ws(", ", "p_name", "p_brand"), F.split("p_name", " ")).alias("accuracy"))


@query("linked_choice", f"""WITH {_PART_INDEX_SQL}, c AS (SELECT p_partkey AS q, id, row_number() OVER (PARTITION BY p_partkey ORDER BY id) AS rank FROM part JOIN idx ON key = array_to_string(regexp_extract_all(lower(p_name), '[\\p{{L}}\\p{{N}}_]+'), ' ')) SELECT q, max(id) AS id, 0.9::DOUBLE AS p FROM c WHERE rank <= 8 GROUP BY q""")
def linked_choice(t):
    keys = t.part.select(F.col("p_partkey").alias("q"), F.array_join(X.tokens(F.col("p_name")), " ").alias("key"))
    found = link.exact_candidates(keys, part_index(t), 8)
    decided = found.groupBy("q").agg(F.max("id").alias("id")).withColumn("p", F.lit(0.9))
    return options.choose_entry(found, decided)


# --- evaluation of retrieval, written paths, single questions' graphs -------------

@query("question_graph_paths", "SELECT DISTINCT o_custkey AS q, o_custkey || '|p:' || l_partkey AS node FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def question_graph_paths(t):
    orders = t.orders.select(F.col("o_custkey").alias("question_id"), node_id("o", "o_orderkey").alias("subject"), F.lit("placed_by").alias("relation"), node_id("c", "o_custkey").alias("object"))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("question_id"), node_id("o", "o_orderkey").alias("subject"), F.lit("contains").alias("relation"), node_id("p", "l_partkey").alias("object"))
    starts = t.orders.select(F.col("o_custkey").alias("q"), F.concat(F.col("o_custkey").cast("string"), F.lit("|"), node_id("c", "o_custkey")).alias("node")).distinct()
    return evaluate.question_graph(orders.unionByName(lines)).follow(starts, [("placed_by", "in"), ("contains", "out")])


def nation_replies(t) -> DataFrame:
    """What a writer might have answered for each nation: two good paths, and three that are none."""
    hop = lambda r, d: f'{{"relation": "{r}", "direction": "{d}"}}'
    replies = [
        f'Here: {{"path": [{hop("lives_in", "in")}, {hop("placed_by", "in")}]}}',
        f'{{"path": [{hop("based_in", "in")}]}}',
        f'{{"path": [{hop("lives_in", "up")}]}}',
        f'{{"path": [{hop("likes", "in")}]}}',
        "no idea",
    ]
    pick = F.get(F.array(*map(F.lit, replies)), F.col("n_nationkey") % len(replies))
    return t.nation.select(node_id("n", "n_nationkey").alias("q"), pick.alias("reply"))


@query("path_problems", "SELECT 'n:' || n_nationkey AS q, CASE n_nationkey % 5 WHEN 2 THEN 'unknown direction up' WHEN 3 THEN 'unknown relation likes' WHEN 4 THEN 'no path' END AS problem FROM nation")
def path_problems(t):
    return evaluate.parsed_paths(nation_replies(t), star_graph(t).schema()).select("q", "problem")


@query("written_paths", "SELECT DISTINCT 'n:' || c_nationkey AS q, 'o:' || o_orderkey AS node FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey % 5 = 0 UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier WHERE s_nationkey % 5 = 1")
def written_paths(t):
    g = stored_star(t)
    good, _ = evaluate.retry(evaluate.parsed_paths(nation_replies(t), g.relations()).withColumn("attempt", F.lit(1)))
    good = settled(good)
    return evaluate.run_paths(g, good, good.select("q", F.col("q").alias("node")))


_LISTS_SQL = """dense AS (SELECT c_custkey AS q, i + 1 AS rank, (c_custkey + i * i) % 25 AS key FROM customer, range(6) r(i)), graph AS (SELECT c_custkey AS q, i + 1 AS rank, (c_custkey * 3 + i) % 25 AS key FROM customer, range(4) r(i) WHERE c_custkey % 7 > 0),
near AS (SELECT q, key, row_number() OVER (PARTITION BY q ORDER BY min(rank), key) AS rank FROM dense GROUP BY q, key), walked AS (SELECT q, key, row_number() OVER (PARTITION BY q ORDER BY min(rank), key) AS rank FROM graph GROUP BY q, key),
gold AS (SELECT c_custkey AS q, c_nationkey AS key FROM customer UNION SELECT c_custkey, c_custkey % 25 FROM customer)"""


@query("evidence_rows", f"""WITH {_LISTS_SQL}, titled AS (SELECT q, key, row_number() OVER (PARTITION BY q ORDER BY min(late), min(CASE WHEN late = 0 THEN 0 ELSE rank END), key) AS rank FROM (SELECT c_custkey AS q, c_nationkey AS key, 0 AS late, 0 AS rank FROM customer UNION ALL SELECT q, key, 1, rank FROM near) GROUP BY q, key),
fused AS (SELECT q, key, row_number() OVER (PARTITION BY q ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, key) AS rank FROM (SELECT q, key, rank FROM near UNION ALL SELECT q, key, rank FROM walked) GROUP BY q, key),
lists AS (SELECT 'dense' AS method, q, key, rank FROM near UNION ALL SELECT 'title+dense', q, key, rank FROM titled UNION ALL SELECT 'graph', q, key, rank FROM walked UNION ALL SELECT 'hybrid', q, key, rank FROM fused),
asked AS (SELECT q, m.method, count(*) AS n FROM gold, (VALUES ('dense'), ('title+dense'), ('graph'), ('hybrid')) AS m(method) GROUP BY ALL), hits AS (SELECT l.method, l.q, count(*) FILTER (rank <= 2) AS h2, count(*) FILTER (rank <= 5) AS h5 FROM lists l JOIN gold g ON g.q = l.q AND g.key = l.key GROUP BY ALL)
SELECT q AS question_id, method, round(coalesce(h2, 0) / n, 6)::DOUBLE AS recall_2, (coalesce(h2, 0) = n)::INTEGER::DOUBLE AS complete_2, round(coalesce(h5, 0) / n, 6)::DOUBLE AS recall_5, (coalesce(h5, 0) = n)::INTEGER::DOUBLE AS complete_5 FROM asked LEFT JOIN hits USING (q, method)""")
def evidence_rows(t):
    asked = t.customer.select(F.col("c_custkey").alias("question_id"), "c_nationkey")
    listed = lambda n, key: asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("question_id", (F.col("i") + 1).alias("rank"), (key % 25).cast("int").alias("key"))
    dense = listed(6, F.col("question_id") + F.col("i") * F.col("i"))
    graph = listed(4, F.col("question_id") * 3 + F.col("i")).where("question_id % 7 > 0")
    mentions = asked.select("question_id", F.col("c_nationkey").alias("key"))
    gold = mentions.union(asked.select("question_id", (F.col("question_id") % 25).cast("int"))).distinct()
    return rounded(evaluate.evidence_rows(dense, graph, mentions, gold, (2, 5)).drop("ranked", "gold"))


@query("named_searches", """WITH rounds AS (SELECT c_custkey AS q, n_name AS query, n_nationkey, c_custkey % 25 AS seen FROM customer JOIN nation ON c_nationkey = n_nationkey), found AS (SELECT q, n_nationkey AS key, 0 AS rank, seen FROM rounds UNION ALL SELECT q, (n_nationkey * 2 + i) % 25, i + 1, seen FROM rounds, range(4) r(i)),
best AS (SELECT q, key, min(rank) AS rank FROM found WHERE key <> seen GROUP BY q, key), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, key) AS n FROM best) SELECT q, string_agg(key::VARCHAR, ',' ORDER BY n) AS found FROM ranked WHERE n <= 3 GROUP BY q""")
def named_searches(t):
    rounds = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("q"), F.col("n_name").alias("query"), F.array((F.col("c_custkey") % 25).cast("int")).alias("seen"))
    names = t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    dense = t.nation.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(F.col("n_name").alias("query"), (F.col("i") + 1).alias("rank"), ((F.col("n_nationkey") * 2 + F.col("i")) % 25).cast("int").alias("key"))
    return evaluate.searched(rounds, names, dense, 3).select("q", F.array_join(F.transform("found", lambda k: k.cast("string")), ",").alias("found"))


@query("windowed_routing", """WITH m AS (SELECT c_custkey % 2 AS w, 'd:' || c_custkey AS document, lower(c_mktsegment) AS key FROM customer), f AS (SELECT key, min(w) AS w FROM m GROUP BY key), d AS (SELECT m.key, min(document) AS document, f.w FROM m JOIN f ON m.key = f.key AND m.w = f.w GROUP BY m.key, f.w)
SELECT m.document, m.key, d.document AS first, m.document = d.document AS created FROM m JOIN d USING (key)""")
def windowed_routing(t):
    mentions = t.customer.select((F.col("c_custkey") % 2).alias("window"), node_id("d", "c_custkey").alias("document"), F.lower("c_mktsegment").alias("key"), F.col("c_mktsegment").alias("name"), F.lit("segment").alias("type"))
    routed = ingest.route_windows(mentions, star_graph(t).names)
    makers = routed.where("created").select("node", F.col("document").alias("first"))
    return routed.join(makers, "node").select("document", "key", "first", "created")
