"""Merges of nodes, any number at once and in chains, with everything that nodes and edges carry.

``merges(absorbed, keep, ord)`` are merges in the order of ``ord``, as if made
one after the other: a node that is absorbed has taken in others before. The
results are those of that sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import Graph, first_by
from .lineage import settled
from .mutate import fold

#: Key of the conflict of merged nodes' types.
TYPE = "@type"


def resolved(merges: DataFrame) -> DataFrame:
    """``(absorbed, keep, way)``: the node that each ends in, and the merges from there down to it.

    Pointers are doubled, so a chain of n merges takes about log2(n) joins. Of a
    node's merges the first counts, and merging a node into itself does nothing;
    a cycle is an error. Ways order all nodes of one that is kept as the sequence
    of merges takes them in: those absorbed earlier first, each before what it
    had absorbed itself.
    """
    first = merges.where("absorbed <> keep").groupBy("absorbed").agg(F.min_by(F.struct("keep", "ord"), F.struct("ord", "keep")).alias("m"))
    now = settled(first.select("absorbed", "m.keep", F.array("m.ord").alias("way"), F.lit(False).alias("done")))
    ended = now.where("false").drop("done")
    # a pointer of r rounds covers 2**r merges; more than all there are is a cycle
    for _ in range(max(1, now.count().bit_length() + 1)):
        if now.isEmpty():
            return ended
        onward = now.select(F.col("absorbed").alias("keep"), F.col("keep").alias("further"), F.col("way").alias("above"))
        known = ended.select(F.col("absorbed").alias("keep"), F.col("keep").alias("further"), F.col("way").alias("above"))
        both = onward.withColumn("last", F.lit(False)).unionByName(known.withColumn("last", F.lit(True)))
        joined = now.join(both, "keep", "left")
        at = F.col("further").isNull()
        step = settled(joined.select("absorbed", F.coalesce("further", "keep").alias("keep"), F.when(at, F.col("way")).otherwise(F.concat("above", "way")).alias("way"), (at | F.col("last")).alias("done")))
        ended = settled(ended.unionByName(step.where("done").drop("done")))
        now = step.where("not done")
    if now.isEmpty():
        return ended
    raise ValueError("merges in a cycle: " + ", ".join(r["absorbed"] for r in now.select("absorbed").orderBy("absorbed").limit(5).collect()))


def _members(ids: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """With ``<column>_now``, where the node is now, and ``<column>_way``, empty for those that stay."""
    to = mapping.select(F.col("absorbed").alias(column), F.col("keep").alias("_keep"), F.col("way").alias("_way"))
    none = F.array().cast(dict(mapping.dtypes)["way"])
    return ids.join(to, column, "left").withColumn(f"{column}_now", F.coalesce("_keep", column)).withColumn(f"{column}_way", F.coalesce("_way", none)).drop("_keep", "_way")


def merged_nodes(nodes: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes(id, type, name, aliases, summary)`` after a resolved mapping, and ``(id, type, sources)`` of type conflicts.

    The node that is kept keeps its type and name; the names and aliases of what
    it absorbed become aliases, each once and none equal to its name; a missing
    summary is the first that there is. A conflict lists every type with the
    nodes that had it.
    """
    own = _members(nodes, mapping, "id")
    called = own.select("id_now", "id_way", F.posexplode(F.concat(F.when(F.size("id_way") > 0, F.array("name")).otherwise(F.array().cast("array<string>")), F.coalesce("aliases", F.array().cast("array<string>")))).alias("i", "alias")).where("alias is not null")
    firsts = called.groupBy("id_now", "alias").agg(F.min(F.struct("id_way", "i")).alias("first"))
    kept = own.where(F.size("id_way") == 0).select("id", "type", "name")
    listed = firsts.join(kept.select(F.col("id").alias("id_now"), "name"), "id_now").where(~F.col("alias").eqNullSafe(F.col("name"))).groupBy("id_now").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "alias"))), lambda x: x["alias"]).alias("aliases"))
    summaries = own.where("summary is not null").groupBy("id_now").agg(first_by(F.col("summary"), F.col("id_way")).alias("summary"))
    out = kept
    for frame in (listed, summaries):
        out = out.join(frame.withColumnRenamed("id_now", "id"), "id", "left")
    types = own.groupBy(F.col("id_now").alias("id"), "type").agg(F.array_sort(F.collect_set("id")).alias("sources"))
    several = types.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    return out.select("id", "type", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "summary"), types.join(several, "id").select("id", "type", "sources")


def merged_attributes(attributes: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``attributes(id, key, value, ord, source_id)`` of nodes folded into where the nodes are now: kept values and conflicts."""
    moved = _members(attributes, mapping, "id")
    return fold(moved.select(F.col("id_now").alias("id"), "key", "value", F.struct("id_way", "ord").alias("ord"), "source_id"))


def _rewired(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    both = _members(_members(edges, mapping, "source"), mapping, "target")
    return both.where((F.col("source_now") != F.col("target_now")) | (F.col("source") == F.col("target")))


def merged_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """``edges(source, type, target, n)`` after a resolved mapping; those that become one add up their ``n``.

    Edges between nodes that are now one go; self-loops that were before stay.
    """
    return _rewired(edges, mapping).groupBy(F.col("source_now").alias("source"), "type", F.col("target_now").alias("target")).agg(F.sum("n").alias("n"))


def merged_edge_attributes(attributes: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``attributes(source, type, target, key, value, ord, source_id)`` of edges folded alike: kept values and conflicts.

    ``id`` is a struct of the edge's ends and type now; an edge that lies where
    it lay is first, then those of nodes absorbed earlier.
    """
    moved = _rewired(attributes, mapping)
    edge = F.struct(F.col("source_now").alias("source"), "type", F.col("target_now").alias("target"))
    order = F.struct("source_way", "target_way", "ord")
    return fold(moved.select(edge.alias("id"), "key", "value", order.alias("ord"), "source_id"))


def merged_provenance(provenance: DataFrame, mapping: DataFrame) -> DataFrame:
    """``provenance(element, source_id, ord)`` of nodes, each source of a node once: ``(element, source_id, rank)`` in their order."""
    moved = _members(provenance.withColumnRenamed("element", "id"), mapping, "id")
    first = moved.groupBy(F.col("id_now").alias("element"), "source_id").agg(F.min(F.struct("id_way", "ord")).alias("first"))
    place = Window.partitionBy("element").orderBy("first", "source_id")
    return first.select("element", "source_id", F.row_number().over(place).cast("int").alias("rank"))


def cascade(graph: Graph, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What goes when ``nodes(id)`` and ``edges(source, type, target)`` do: one row of counts.

    ``n_nodes`` and ``n_edges`` that exist of those named, and ``n_touching``,
    the further edges that lose an end.
    """
    gone = graph.nodes.select("id").join(nodes.select("id").distinct(), "id", "left_semi")
    keys = ["source", "type", "target"]
    own = graph.edges.select(*keys).join(edges.select(*keys).distinct(), keys, "left_semi")
    others = graph.edges.select(*keys).join(edges.select(*keys).distinct(), keys, "left_anti")
    hit = lambda end: gone.select(F.col("id").alias(end), F.lit(True).alias(f"{end}_gone"))
    touching = others.join(hit("source"), "source", "left").join(hit("target"), "target", "left").where("source_gone or target_gone")
    count = lambda frame, name: frame.agg(F.count("*").alias(name))
    return count(gone, "n_nodes").crossJoin(count(own, "n_edges")).crossJoin(count(touching, "n_touching"))
