"""The library in one object: a graph with its documents, kept as versioned Parquet.

Questions, documents and answers are frames: a call works on any number of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import content_hash, edge_id
from .operators import ingest as steps
from .operators import link, locate, walk
from .operators.decide import Decider, LexicalDecider
from .operators.graph import Graph
from .sources import adjacency, replies, snapshot, triples

SCHEMAS = {
    "nodes": "id string, type string, name string",
    "edges": "source string, type string, target string",
    "provenance": "element string, source_id string, key string, start int, end int, confidence double",
    "documents": "key string, title string, text string, hash string",
}


#: Stands for the hash of a document of which some chunk has no readable reply.
INCOMPLETE = "incomplete"


class Index:
    def __init__(self, spark: SparkSession, path: str) -> None:
        """Open the last version in a folder, or start an empty one."""
        self.spark, self.path = spark, path
        self._stored: Graph | None = None
        if snapshot.versions(spark, path):
            self.frames = snapshot.read_version(spark, path, tuple(SCHEMAS))
        else:
            self.frames = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}

    @property
    def graph(self) -> Graph:
        """The last version's; its moves in buckets, unless it was broken off before they were written."""
        if self._stored is None and (last := max(snapshot.versions(self.spark, self.path), default=0)):
            buckets = f"{self.path.rstrip('/')}/v{last}/buckets"
            if adjacency.is_stored(self.spark, buckets):
                self._stored = adjacency.open_stored(self.spark, buckets, self.frames["edges"])
        return self._stored or Graph(self.frames["nodes"], self.frames["edges"])

    def _keep(self, **changed: DataFrame) -> None:
        number = snapshot.write_version(self.path, self.frames | changed)
        self.frames = snapshot.read_version(self.spark, self.path, tuple(SCHEMAS))
        self._stored = adjacency.store(Graph(self.frames["nodes"], self.frames["edges"]), f"{self.path.rstrip('/')}/v{number}/buckets")

    def import_triples(self, path: str, default_type: str = "entity") -> DataFrame:
        """Add a triple file; returns the report with new nodes, edges and skipped lines."""
        rows, skipped = triples.read_triples(self.spark, path)
        nodes, edges, report = triples.import_triples(self.frames["nodes"], self.frames["edges"], rows, default_type)
        counts = report.crossJoin(skipped).collect()  # one row
        self._keep(nodes=nodes, edges=edges.select("source", "type", "target"))
        return self.spark.createDataFrame(counts)

    def ingest(self, documents: DataFrame, extract: Callable[[DataFrame], DataFrame], limit: int = 2000, version: str = "1") -> DataFrame:
        """Bring the graph up to date with all ``documents(key, title, text)``; returns their states.

        Only new and changed documents are chunked and given to ``extract``,
        which turns ``(chunk, text, error)`` into ``(chunk, reply)``. Replies are
        kept (``sources.replies``): ingestion that broke off asks only for the
        rest, and a document without a readable reply to each chunk is tried
        again by the next call. ``version`` names the extractor. What changed or
        removed documents alone supported goes. Elements without provenance
        (imported ones) stay.
        """
        now = documents.select("key", "title", "text", content_hash(F.coalesce("text", F.lit(""))).alias("hash"))
        states = walk.settled(steps.ledger_diff(now, self.frames["documents"]))
        taken_back = states.where("state in ('changed', 'removed')").select("key")
        fresh = now.join(states.where("state in ('new', 'changed')").select("key"), "key", "left_semi")

        old = self.frames["provenance"]
        left = old.join(taken_back, "key", "left_anti")
        gone = old.select("element").distinct().join(left.select("element").distinct(), "element", "left_anti")
        edges = self.frames["edges"].withColumn("element", edge_id(F.col("source"), F.col("type"), F.col("target"))).join(gone, "element", "left_anti").drop("element")
        nodes = self.frames["nodes"].join(gone, self.frames["nodes"]["id"] == gone["element"], "left_anti")

        chunks = locate.chunked(fresh, limit).select(F.concat_ws("#", "key", "chunk").alias("chunk"), "key", "pieces", "text")
        chunks = walk.settled(chunks)
        said = walk.settled(replies.extracted(chunks.select("chunk", "text"), extract, f"{self.path.rstrip('/')}/replies", version))
        failed = said.where("error is not null").join(chunks.select("chunk", "key"), "chunk").select("key").distinct().withColumn("failed", F.lit(True))
        fresh = fresh.join(failed, "key", "left").withColumn("hash", F.when(F.col("failed"), INCOMPLETE).otherwise(F.col("hash"))).drop("failed")
        mentions, facts = steps.clean_extractions(steps.parse_extractions(said.where("error is null").select("chunk", "reply")))
        placed = mentions.join(chunks.select("chunk", F.col("key").alias("document")), "chunk")
        routed = walk.settled(steps.route_by_name(placed.select("document", "key", "name", "type").distinct(), Graph(nodes, edges).names).dropDuplicates(["document", "key"]))
        own = placed.select("chunk", "document", "key").join(routed.select("document", "key", "node"), ["document", "key"])
        made = routed.where("created").select(F.col("node").alias("id"), "type", "name").dropDuplicates(["id"])
        ends = own.select("chunk", "key", "node")
        linked = (
            facts.join(ends.withColumnsRenamed({"key": "source", "node": "s"}), ["chunk", "source"])
            .join(ends.withColumnsRenamed({"key": "target", "node": "t"}), ["chunk", "target"])
            .join(chunks.select("chunk", F.col("key").alias("document"), "pieces", "text"), "chunk")
            .where("s <> t")
        )
        span = locate.find_evidence(F.col("text"), F.col("evidence"))
        found = linked.select(F.col("s").alias("source"), "type", F.col("t").alias("target"), "document", "pieces", span.alias("e"))
        found = found.withColumn("d", locate.chunk_to_document(F.col("pieces"), F.col("e.start"), F.col("e.end")))
        supports = found.select(edge_id(F.col("source"), F.col("type"), F.col("target")).alias("element"), F.col("document").alias("source_id"), F.col("document").alias("key"), F.col("d.start").cast("int").alias("start"), F.col("d.end").cast("int").alias("end"), F.lit(1.0).alias("confidence"))
        named = own.select(F.col("node").alias("element"), F.col("document").alias("source_id"), F.col("document").alias("key"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(1.0).alias("confidence")).distinct()
        self._keep(
            nodes=nodes.unionByName(made.join(nodes.select("id"), "id", "left_anti")),
            edges=edges.unionByName(found.select("source", "type", "target")).distinct(),
            provenance=left.unionByName(supports).unionByName(named),
            documents=snapshot.put_documents(self.frames["documents"].join(taken_back, "key", "left_anti"), fresh),
        )
        return states

    def incomplete(self) -> DataFrame:
        """Documents that the next ingestion tries again: ``(key)``."""
        return self.frames["documents"].where(F.col("hash") == INCOMPLETE).select("key")

    def link(self, questions: DataFrame, entries: int = 2) -> DataFrame:
        return link.link(questions, self.frames["nodes"].select("id", "name"), entries)

    def walk(self, questions: DataFrame, decider: Decider | None = None, config: walk.WalkConfig | None = None) -> DataFrame:
        """``questions(q, question)`` to ranked answers with their paths and confidence."""
        starts = self.link(questions).join(questions, "q").select("q", "question", F.col("id").alias("node"), F.col("rank").alias("ord"))
        return walk.walk(self.graph, starts, decider or LexicalDecider(0.5), config or walk.WalkConfig(unit="relation"))

    def walked_edges(self, answers: DataFrame) -> DataFrame:
        """``(q, answer, hop, edge)`` of the answers' paths, followed again from their starts."""
        edge = F.when(F.col("dir") == "out", edge_id(F.col("node"), F.col("rel"), F.col("other"))).otherwise(edge_id(F.col("other"), F.col("rel"), F.col("node")))
        graph = self.graph
        at = answers.select("q", F.col("rank").alias("answer"), "path", F.explode(F.split("start", ",")).alias("node"))
        out = None
        for hop in range(answers.agg(F.max(F.size("path"))).first()[0] or 0):
            here = at.where(F.size("path") > hop).withColumn("own_rel", F.col("path")[hop]["rel"]).withColumn("own_dir", F.col("path")[hop]["dir"])
            step = graph.meet(here).where("rel = own_rel and dir = own_dir").withColumn("edge", edge).drop("rel", "dir", "own_rel", "own_dir")
            own = step.select("q", "answer", F.lit(hop).alias("hop"), "edge").distinct()
            out = own if out is None else out.unionByName(own)
            at = step.select("q", "answer", "path", F.col("other").alias("node")).distinct()
        return out if out is not None else self.spark.createDataFrame([], f"q {dict(answers.dtypes)['q']}, answer int, hop int, edge string")

    def locate(self, questions: DataFrame, mode: str = "hybrid", k: int = 5, limit: int = 800) -> DataFrame:
        """``(q, rank, key, start, end)``: spans of the documents, by chunks, by walked edges or both fused."""
        documents = self.frames["documents"].select("key", "text")
        lists = []
        if mode in ("graph", "hybrid"):
            proofs = self.frames["provenance"].select("element", "key", "start", "end", "confidence")
            answers = walk.settled(self.walk(questions).where("rank <= 3"))
            reached = answers.select("q", F.col("rank").alias("answer"), F.explode("frontier").alias("node"))
            entries = self.link(questions).select(F.col("q").cast("string").alias("q"), F.col("rank").alias("ord"), F.col("id").alias("node"))
            ranked = locate.graph_spans(self.walked_edges(answers), reached, entries, proofs, k)
            lists.append(ranked.select(F.col("q").cast("string").alias("q"), F.lit(0).alias("list"), (F.col("rank") - 1).alias("rank"), "key", "start", "end"))
        if mode in ("dense", "hybrid"):
            chunks = locate.chunked(documents, limit)
            near = locate.locate_dense(questions, documents, k, limit)
            bounds = chunks.select("key", "chunk", F.col("pieces")[0]["start"].alias("start"), F.element_at("pieces", -1)["end"].alias("end"))
            lists.append(near.join(bounds, ["key", "chunk"]).select(F.col("q").cast("string").alias("q"), F.lit(1).alias("list"), (F.col("rank") - 1).alias("rank"), "key", "start", "end"))
        if not lists:
            raise ValueError("mode must be graph, dense or hybrid")
        both = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
        return locate.fuse_spans(both, k)

    def read(self, locations: DataFrame, context: int = 0) -> DataFrame:
        """The text of located spans, and whether their documents have changed since ``seen_hash``."""
        seen = locations if "seen_hash" in locations.columns else locations.withColumn("seen_hash", F.lit(None).cast("string"))
        return locate.read_spans(seen.select("q", "key", "start", "end", "seen_hash"), self.frames["documents"], context)

    def neighbors(self, ids: DataFrame, types: list[str] | None = None, direction: str = "both", limit: int = 25) -> DataFrame:
        return self.graph.neighbors(ids, types, direction).where(F.col("position") <= limit)

    def status(self) -> DataFrame:
        return self.graph.counts().crossJoin(self.frames["documents"].agg(F.count("*").alias("n_documents")))


def best_entries(answers: DataFrame) -> DataFrame:
    """The most confident first answer of each question over all its walks."""
    place = Window.partitionBy("q").orderBy(F.desc("confidence"), "rank")
    return answers.withColumn("n", F.row_number().over(place)).where("n = 1").drop("n")
