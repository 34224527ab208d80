"""The star-schema tables as a property graph and as evaluation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph


class Tables:
    """Parquet tables of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def node_id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


#: relation, table, subject (prefix, key), object (prefix, key)
FACTS = (
    ("in_region", "nation", ("n", "n_nationkey"), ("r", "n_regionkey")),
    ("lives_in", "customer", ("c", "c_custkey"), ("n", "c_nationkey")),
    ("based_in", "supplier", ("s", "s_suppkey"), ("n", "s_nationkey")),
    ("placed_by", "orders", ("o", "o_orderkey"), ("c", "o_custkey")),
    ("contains", "lineitem", ("o", "l_orderkey"), ("p", "l_partkey")),
    ("supplied_by", "lineitem", ("p", "l_partkey"), ("s", "l_suppkey")),
)
#: type, table, prefix, key, name
KINDS = (
    ("region", "region", "r", "r_regionkey", "r_name"),
    ("nation", "nation", "n", "n_nationkey", "n_name"),
    ("customer", "customer", "c", "c_custkey", "c_name"),
    ("supplier", "supplier", "s", "s_suppkey", "s_name"),
    ("part", "part", "p", "p_partkey", "p_name"),
    ("order", "orders", "o", "o_orderkey", None),
)


def triples(t: Tables, distinct: bool = False) -> DataFrame:
    """``(subject, relation, object)``, with repeats as the tables have them or without.

    Only the line items repeat a pair of keys; the other tables need no shuffle.
    """
    out = None
    for relation, table, (sp, sk), (op, ok) in FACTS:
        keys = getattr(t, table).select(sk, ok)
        if distinct and table == "lineitem":
            keys = keys.distinct()
        own = keys.select(node_id(sp, sk).alias("subject"), F.lit(relation).alias("relation"), node_id(op, ok).alias("object"))
        out = own if out is None else out.unionByName(own)
    return out


def nodes(t: Tables) -> DataFrame:
    out = None
    for kind, table, prefix, key, name in KINDS:
        label = F.col(name) if name else F.concat(F.lit("Order "), F.col(key).cast("string"))
        own = getattr(t, table).select(node_id(prefix, key).alias("id"), F.lit(kind).alias("type"), label.alias("name"))
        out = own if out is None else out.unionByName(own)
    return out


def star_graph(t: Tables) -> Graph:
    edges = triples(t, distinct=True).select(F.col("subject").alias("source"), F.col("relation").alias("type"), F.col("object").alias("target"))
    return Graph(nodes(t), edges)


def _unions(parts) -> str:
    return "\n  UNION ALL ".join(parts)


#: The same in SQL, before every query of the catalogue that needs it.
GRAPH_SQL = (
    "WITH triples AS (\n  "
    + _unions(f"SELECT '{sp}:' || {sk} AS subject, '{rel}' AS relation, '{op}:' || {ok} AS object FROM {table}" for rel, table, (sp, sk), (op, ok) in FACTS)
    + "\n), edges AS (SELECT DISTINCT subject AS source, relation AS type, object AS target FROM triples\n), nodes AS (\n  "
    + _unions(f"SELECT '{prefix}:' || {key} AS id, '{kind}' AS type, {name or repr('Order ') + ' || ' + key} AS name FROM {table}" for kind, table, prefix, key, name in KINDS)
    + "\n), adj AS (SELECT source AS node, type AS rel, 'out' AS dir, target AS other FROM edges"
    "\n  UNION ALL SELECT target, type, 'in', source FROM edges WHERE source <> target)\n"
)


def scores(t: Tables) -> DataFrame:
    """Two systems' records for every order: deterministic stand-ins for an evaluation's output."""
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    h = ((F.col("o_orderkey") * 7919 + F.col("k") * 104729 + F.floor(F.col("o_totalprice")).cast("long")) % 1000).alias("h")
    base = rows.select("o_orderkey", "o_orderpriority", "k", h)
    f1 = F.least(F.lit(1.0), (F.col("h") % 23).cast("double") / 20.0)
    return base.select(
        F.when(F.col("k") == 1, "walk").otherwise("search").alias("system"),
        F.col("o_orderkey").alias("question_id"),
        F.col("o_orderpriority").alias("type"),
        f1.alias("f1"),
        (f1 >= 1).cast("double").alias("em"),
        (f1 >= 0.5).cast("double").alias("hits"),
        F.when(F.col("h") % 29 == 0, "error").when(F.col("h") % 31 == 0, "aborted").otherwise("ok").alias("status"),
        F.when(F.col("h") % 13 != 0, (F.col("h") % 50).cast("double") / 1000.0).alias("cost"),
        ((F.col("h") % 700).cast("double") / 100.0 + 0.1).alias("latency"),
        (F.col("h") % 6).alias("calls"),
        F.when(F.col("h") % 17 != 0, ((F.col("h") * 37) % 1000).cast("double") / 1000.0).alias("confidence"),
        (F.col("h") % 19 == 0).alias("no_decision"),
        (F.col("h") % 3).alias("seed"),
    )


SCORES_SQL = """WITH hashed AS (
  SELECT o_orderkey, o_orderpriority, k, (o_orderkey * 7919 + k * 104729 + floor(o_totalprice)::BIGINT) % 1000 AS h
  FROM orders CROSS JOIN (VALUES (1), (2)) AS systems(k)
), scores AS (
  SELECT CASE WHEN k = 1 THEN 'walk' ELSE 'search' END AS system, o_orderkey AS question_id, o_orderpriority AS type,
    least(1.0::DOUBLE, (h % 23)::DOUBLE / 20) AS f1, CASE WHEN h % 23 >= 20 THEN 1::DOUBLE ELSE 0::DOUBLE END AS em,
    CASE WHEN h % 23 >= 10 THEN 1::DOUBLE ELSE 0::DOUBLE END AS hits,
    CASE WHEN h % 29 = 0 THEN 'error' WHEN h % 31 = 0 THEN 'aborted' ELSE 'ok' END AS status,
    CASE WHEN h % 13 <> 0 THEN (h % 50)::DOUBLE / 1000 END AS cost, (h % 700)::DOUBLE / 100 + 0.1::DOUBLE AS latency, h % 6 AS calls,
    CASE WHEN h % 17 <> 0 THEN ((h * 37) % 1000)::DOUBLE / 1000 END AS confidence, h % 19 = 0 AS no_decision, h % 3 AS seed
  FROM hashed
), sure AS (
  SELECT system, question_id, coalesce(confidence, 0::DOUBLE) AS c, em AS y FROM scores
)
"""
