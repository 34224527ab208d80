"""Graph changes as DataFrame rewrites: upsert, delete, merge, retract, rename."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edge_id
from .graph import Graph, first_by


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those with the same keys; of several new ones the last ``ord`` wins."""
    last = Window.partitionBy(*keys).orderBy(F.desc("ord"))
    fresh = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "ord")
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def delete_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """Without the nodes of ``ids(id)`` and every edge that touches them."""
    gone = ids.select("id").distinct()
    edges = graph.edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti"), edges.select(*graph.edges.columns))


def delete_edges(graph: Graph, edges: DataFrame) -> Graph:
    return Graph(graph.nodes, graph.edges.join(edges.select("source", "type", "target"), ["source", "type", "target"], "left_anti").select(*graph.edges.columns))


def rewired(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """``edges(source, type, target, n)`` after ``mapping(absorbed, keep)`` in one step; ``merge.merged_edges`` follows chains.

    Edges between merged nodes go, self-loops that existed before stay, and
    edges that become one add up their ``n``.
    """
    to = mapping.select("absorbed", "keep")
    moved = (
        edges.join(to.withColumnsRenamed({"absorbed": "source", "keep": "s"}), "source", "left")
        .join(to.withColumnsRenamed({"absorbed": "target", "keep": "t"}), "target", "left")
        .select(F.coalesce("s", "source").alias("source"), "type", F.coalesce("t", "target").alias("target"), "n", (F.col("source") == F.col("target")).alias("loop"))
    )
    return moved.where("source <> target or loop").groupBy("source", "type", "target").agg(F.sum("n").alias("n"))


def fold(attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, key, value, ord, source_id)`` to the kept values and to the conflicts.

    The first value of a key is kept; equal ones add their sources; a key with
    two or more distinct values is a conflict that lists each with its sources.
    """
    kept = attributes.groupBy("id", "key").agg(first_by(F.col("value"), F.col("ord"), F.col("value")).alias("value"))
    sources = attributes.groupBy("id", "key", "value").agg(F.array_sort(F.collect_set("source_id")).alias("sources"))
    several = attributes.groupBy("id", "key").agg(F.countDistinct("value").alias("n")).where("n > 1").select("id", "key")
    return kept.join(sources, ["id", "key", "value"]), sources.join(several, ["id", "key"])


def retract(provenance: DataFrame, attributes: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take sources back: ``provenance(element, source_id)``, ``attributes(id, key, value, ord, source_id)``.

    Returns elements that lose all support, and the attributes that keep some:
    of the values left the first one that still has a source is current, so a
    conflict's only survivor moves up.
    """
    gone = sources.select("source_id").distinct()
    left = provenance.join(gone, "source_id", "left_anti")
    unsupported = provenance.select("element").distinct().join(left.select("element").distinct(), "element", "left_anti")
    return unsupported, fold(attributes.join(gone, "source_id", "left_anti"))[0]


def rename_relations(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Apply ``mapping(type, new_type, reversed)``; edges that become one add up their ``n``."""
    flip = F.coalesce("reversed", F.lit(False))
    out = edges.join(mapping, "type", "left").select(
        F.when(flip, F.col("target")).otherwise(F.col("source")).alias("source"),
        F.coalesce("new_type", "type").alias("type"),
        F.when(flip, F.col("source")).otherwise(F.col("target")).alias("target"),
        "n",
    )
    merged = out.groupBy("source", "type", "target").agg(F.sum("n").alias("n"))
    return merged.withColumn("id", edge_id(F.col("source"), F.col("type"), F.col("target")))


def attribute_edges(values: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """``values(id, key, value)`` that name exactly one other node become edges, but for existing ones."""
    usable = values.where(F.col("value").rlike(r"[\p{L}]") & ~F.col("value").rlike(r"^[0-9]{4}(-[0-9]{2}){0,2}$"))
    single = names.groupBy("key").agg(F.min("id").alias("target"), F.countDistinct("id").alias("n")).where("n = 1").select(F.col("key").alias("name"), "target")
    hit = usable.withColumn("name", F.lower("value")).join(single, "name").where("id <> target")
    found = hit.select(F.col("id").alias("source"), F.col("key").alias("type"), "target").distinct()
    return found.join(edges.select("source", "type", "target"), ["source", "type", "target"], "left_anti")
