"""A property graph as DataFrames: scans, look-ups, adjacency, degrees, histograms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edge_id, name_key_sql
from .lineage import first_rows, settled

DIRECTIONS = ("out", "in", "both")


def first_by(value: Column, *order: Column) -> Column:
    """The value of the row that is first in the order; max_by would take a later one of ties."""
    return F.min_by(value, F.struct(*order))


def neighbor_order() -> list[Column]:
    """Outgoing before incoming, then relation, then the other node."""
    return [(F.col("dir") != "out"), F.col("rel"), F.col("other")]


@dataclass(frozen=True)
class Graph:
    """``nodes(id, type, name[, summary, aliases, ...])`` and ``edges(source, type, target[, ...])``.

    Cold columns (attributes, provenance) stay columns of their own, so scans
    that don't ask for them never read them.
    """

    nodes: DataFrame
    edges: DataFrame

    @cached_property
    def adjacency(self) -> DataFrame:
        """``(node, rel, dir, other)``: each edge from both ends, a self-loop once, as outgoing."""
        out = self.edges.select(F.col("source").alias("node"), F.col("type").alias("rel"), F.lit("out").alias("dir"), F.col("target").alias("other"))
        back = self.edges.where("source <> target").select(F.col("target").alias("node"), F.col("type").alias("rel"), F.lit("in").alias("dir"), F.col("source").alias("other"))
        return out.unionByName(back)

    @cached_property
    def names(self) -> DataFrame:
        """``(id, name, key)``: names and aliases with their case-insensitive keys."""
        own = self.nodes.select("id", "name")
        if "aliases" in self.nodes.columns:
            own = own.union(self.nodes.select("id", F.explode("aliases").alias("name")))
        return own.where("name is not null").select("id", "name", name_key_sql(F.col("name")).alias("key")).dropDuplicates(["id", "key"])

    def moves(self, types: list[str] | None = None, direction: str = "both") -> DataFrame:
        """The adjacency of some relations (None: all, an empty list: none) and one direction."""
        if direction not in DIRECTIONS:
            raise ValueError(f"direction must be one of {DIRECTIONS}")
        found = self.adjacency
        if direction == "out":
            found = found.where("dir = 'out'")
        elif direction == "in":
            loops = self.edges.where("source = target").select(F.col("target").alias("node"), F.col("type").alias("rel"), F.lit("in").alias("dir"), F.col("source").alias("other"))
            found = found.where("dir = 'in'").unionByName(loops)
        if types is not None:
            found = found.where(F.col("rel").isin(*types)) if types else found.where(F.lit(False))
        return found

    def meet(self, frontier: DataFrame, types: list[str] | None = None, direction: str = "both") -> DataFrame:
        """The rows of ``frontier(node, ...)`` with each move from their node: ``rel``, ``dir``, ``other``."""
        return frontier.join(self.moves(types, direction), "node")

    def count_met(self, frontier: DataFrame, types: list[str] | None = None, direction: str = "both") -> DataFrame:
        """The rows of ``frontier(node, ...)`` with each relation of their node, ``rel``, and how many moves it has, ``n``.

        The moves are counted before they meet the frontier; a relation's number may come in parts.
        """
        return frontier.join(self.moves(types, direction).groupBy("node", "rel").agg(F.count("*").alias("n")), "node")

    def neighbors(self, ids: DataFrame, types: list[str] | None = None, direction: str = "both") -> DataFrame:
        """``ids(node)`` to its neighbours with names, in a position per node."""
        place = Window.partitionBy("node").orderBy(*neighbor_order())
        labels = self.nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
        near = self.meet(ids.select("node").distinct(), types, direction)
        return near.withColumn("position", F.row_number().over(place).cast("long")).join(labels, "other")

    def missing(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.nodes.select(F.col("id").alias("node")), "node", "left_anti")

    def get_nodes(self, ids: DataFrame) -> DataFrame:
        """``ids(id)``; ids that don't exist give no row."""
        return self.nodes.join(ids.select("id").distinct(), "id", "left_semi")

    def find_nodes(self, name: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
        """By name or alias without case, and type, in the order of ids."""
        found = self.nodes if kind is None else self.nodes.where(F.col("type") == kind)
        if name is not None:
            key = " ".join(name.lower().split())
            found = found.join(self.names.where(F.col("key") == key).select("id").distinct(), "id", "left_semi")
        found = found.orderBy("id")
        return found if limit is None else found.limit(max(0, limit))

    def labels(self, ids: DataFrame) -> DataFrame:
        kept = [c for c in ("id", "name", "type", "summary") if c in self.nodes.columns]
        return self.get_nodes(ids).select(*kept)

    def counts(self) -> DataFrame:
        return self.nodes.agg(F.count("*").alias("n_nodes")).crossJoin(self.edges.agg(F.count("*").alias("n_edges")))

    def degrees(self, types: list[str] | None = None, direction: str = "both") -> DataFrame:
        return self.moves(types, direction).groupBy("node").agg(F.count("*").alias("degree"))

    def degrees_by_relation(self, types: list[str] | None = None, direction: str = "both") -> DataFrame:
        return self.moves(types, direction).groupBy("node", "dir", "rel").agg(F.count("*").alias("degree"))

    def get_edges(self, ids: DataFrame) -> DataFrame:
        """``ids(id)`` to the edges with these derived ids; ids that don't exist give no row."""
        named = self.edges.withColumn("id", edge_id(F.col("source"), F.col("type"), F.col("target")))
        return named.join(ids.select("id").distinct(), "id", "left_semi").select("id", "source", "type", "target")

    def walkable(self, types: list[str]) -> Graph:
        """Only edges of these relations that have evidence, where the edges tell it."""
        kept = self.edges.where(F.col("type").isin(*types))
        return Graph(self.nodes, kept.where(F.size("evidence") > 0) if "evidence" in kept.columns else kept)

    def cleared(self) -> Graph:
        """The graph without anything in it."""
        return Graph(self.nodes.where("false"), self.edges.where("false"))

    def relation_histogram(self, ids: DataFrame | None = None, top: int | None = 50) -> DataFrame:
        """Edges per (relation, direction), the most common first."""
        near = self.adjacency if ids is None else self.meet(ids.select("node").distinct())
        counted = near.groupBy("rel", "dir").agg(F.count("*").alias("n"))
        return counted.orderBy(F.desc("n"), "rel", "dir").limit(top) if top else counted

    def typed_edges(self) -> DataFrame:
        kinds = self.nodes.select("id", "type")
        return (
            self.edges.select("source", "type", "target")
            .join(kinds.withColumnsRenamed({"id": "source", "type": "source_type"}), "source")
            .join(kinds.withColumnsRenamed({"id": "target", "type": "target_type"}), "target")
        )

    def schema(self) -> DataFrame:
        """Per relation its edges and its most common end types, ties to the smallest edge id."""
        pairs = self.typed_edges().groupBy("type", "source_type", "target_type").agg(F.count("*").alias("n"), F.min(edge_id(F.col("source"), F.col("type"), F.col("target"))).alias("first"))
        order = [(-F.col("n")).alias("k"), F.col("first")]
        return pairs.groupBy("type").agg(F.sum("n").alias("edges"), first_by(F.col("source_type"), *order).alias("source_type"), first_by(F.col("target_type"), *order).alias("target_type"))

    def relations(self) -> DataFrame:
        """The relations that edges have, ``(type)``."""
        return self.edges.select("type").distinct()

    def relation_signature(self) -> DataFrame:
        """End types of the first edge of each relation, by source and target."""
        order = [F.col("source"), F.col("target")]
        return self.typed_edges().groupBy("type").agg(first_by(F.col("source_type"), *order).alias("source_type"), first_by(F.col("target_type"), *order).alias("target_type"))

    def top_types(self, top: int = 50) -> DataFrame:
        return self.nodes.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(top)

    def dangling(self) -> DataFrame:
        """Edges that lack an end among the nodes."""
        ids = self.nodes.select("id")
        ends = self.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
        return ends.unionByName(self.edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select(*ends.columns)).distinct()

    def local_relations(self, starts: DataFrame, hops: int = 2, max_nodes: int = 5000) -> DataFrame:
        """Edges per relation around ``starts(start, node)``.

        An edge counts once for each of its ends that is expanded. At most
        ``max_nodes`` nodes are expanded for each start, nearer ones and then
        smaller ids first.
        """
        frontier = starts.select("start", "node", F.lit(0).alias("hop")).distinct()
        seen = frontier
        for hop in range(1, hops):
            step = self.meet(frontier).select("start", F.col("other").alias("node"), F.lit(hop).alias("hop")).distinct()
            frontier = settled(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
            seen = seen.unionByName(frontier)
        expanded = first_rows(seen, ["start"], ["hop", "node"], max_nodes).select("start", "node")
        return self.count_met(expanded).groupBy("start", "rel").agg(F.sum("n").alias("n"))

    def follow(self, starts: DataFrame, path: list[tuple[str, str]]) -> DataFrame:
        """``starts(q, node)`` along a path of (relation, direction) hops; nodes of one q aren't met again."""
        frontier = starts.select("q", "node").distinct()
        visited = frontier
        for rel, direction in path:
            step = self.meet(frontier, [rel], direction).select("q", F.col("other").alias("node")).distinct()
            frontier = settled(step.join(visited, ["q", "node"], "left_anti"))
            visited = visited.unionByName(frontier)
        return frontier


def ordered_union(rows: DataFrame, keys: list[str], item: str, order: str, out: str) -> DataFrame:
    """Each group's distinct items as an array, in the order in which they first come."""
    first = rows.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.min(order).alias("_first"))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_first", item))).alias("_all"))
    return listed.select(*keys, F.transform("_all", lambda x: x[item]).alias(out))


def elements_from(elements: DataFrame, sources: DataFrame) -> DataFrame:
    """``elements(kind, id, provenance array<struct<source_id,...>>)`` with provenance from ``sources(source_id)``."""
    long = elements.select("kind", "id", F.explode("provenance").alias("p")).select("kind", "id", F.col("p.source_id").alias("source_id"))
    return long.join(sources.select("source_id").distinct(), "source_id", "left_semi").select("kind", "id").distinct()
