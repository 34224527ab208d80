"""Retrieval evaluation, written paths and graphs of single questions, as frames.

What a hosted model would write or choose comes in as rows; everything before
and after it is joins and windows over all questions at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import Graph
from .lineage import settled
from .metrics import first_per_document, reciprocal_rank_fusion

#: What a written path must be.
PATH = "struct<path:array<struct<relation:string,direction:string>>>"


def question_graph(triples: DataFrame) -> Graph:
    """``triples(question_id, subject, relation, object)`` as one graph in which no question sees another's edges.

    A node's id is its question's and its own, so every operator on graphs works
    on all questions' graphs at once.
    """
    own = lambda c: F.concat_ws("|", F.col("question_id").cast("string"), c)
    edges = triples.select(own("subject").alias("source"), F.col("relation").alias("type"), own("object").alias("target")).distinct()
    ends = triples.select("question_id", F.explode(F.array("subject", "object")).alias("name")).distinct()
    return Graph(ends.select(own("name").alias("id"), F.lit("entity").alias("type"), "name", "question_id"), edges)


def parsed_paths(replies: DataFrame, relations: DataFrame, most: int = 4) -> DataFrame:
    """``replies(q, reply)`` to ``(q, path, problem)``: hops of (relation, direction), or what is wrong with them.

    A path is JSON with known relations (``relations(type)``, a schema's few) and
    directions, of one hop at least; problems are what a writer is told before
    it tries again.
    """
    read = replies.select("q", F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), PATH)["path"].alias("path"))
    hops = read.select("q", F.posexplode("path").alias("i", "hop")).select("q", "i", "hop.*")
    known = F.broadcast(relations.select(F.col("type").alias("relation"), F.lit(True).alias("known")).distinct()) if relations.count() <= 10_000 else relations.select(F.col("type").alias("relation"), F.lit(True).alias("known")).distinct()
    wrong = (
        hops.join(known, "relation", "left")
        .select("q", "i", F.when(F.col("known").isNull(), F.concat(F.lit("unknown relation "), F.coalesce("relation", F.lit("(none)")))).when(~F.coalesce(F.col("direction").isin("out", "in"), F.lit(False)), F.concat(F.lit("unknown direction "), F.coalesce("direction", F.lit("(none)")))).alias("problem"))
        .where("problem is not null")
        .groupBy("q")
        .agg(F.min_by("problem", "i").alias("problem"))
    )
    size = F.coalesce(F.size("path"), F.lit(-1))
    shape = F.when(F.col("path").isNull(), "no path").when(size == 0, "empty path").when(size > most, f"more than {most} hops")
    return read.join(wrong, "q", "left").select("q", "path", F.coalesce(shape, "problem").alias("problem"))


def run_paths(graph: Graph, paths: DataFrame, starts: DataFrame) -> DataFrame:
    """``paths(q, path)`` from ``starts(q, node)``: ``(q, node)``, each question along its own path.

    Hop by hop for all questions; nodes that a question has met are not met again.
    """
    at = starts.join(paths.select("q", "path"), "q").select("q", "path", "node").distinct()
    seen, done = at.select("q", "node"), at.where(F.size("path") == 0).select("q", "node")
    hops = paths.agg(F.max(F.size("path"))).first()[0] or 0
    relations = paths.select(F.explode("path.relation").alias("relation")).distinct().limit(1001).collect()
    # few relations are asked of the stored edges themselves
    used = [r["relation"] for r in relations] if len(relations) <= 1000 else None
    for hop in range(hops):
        here = at.where(F.size("path") > hop).select("q", "path", "node", F.col("path")[hop]["relation"].alias("relation"), F.col("path")[hop]["direction"].alias("direction"))
        step = graph.meet(here, used).where("rel = relation and dir = direction").select("q", "path", F.col("other").alias("node")).distinct()
        at = settled(step.join(seen, ["q", "node"], "left_anti"))
        seen = seen.union(at.select("q", "node"))
        done = done.union(at.where(F.size("path") == hop + 1).select("q", "node"))
    return done


def retry(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``attempts(q, attempt, path, problem)``: the first good path of each question, and the last problem of those without."""
    good = attempts.where("problem is null").groupBy("q").agg(F.min_by("path", "attempt").alias("path"))
    bad = attempts.join(good.select("q"), "q", "left_anti").groupBy("q").agg(F.max_by("problem", "attempt").alias("problem"), F.max("attempt").alias("attempt"))
    return good, bad


def titled_first(mentions: DataFrame, ranking: DataFrame) -> DataFrame:
    """``mentions(question_id, key)`` before ``ranking(question_id, rank, key)``, each key once, ranks from 1."""
    named = mentions.select("question_id", F.lit(0).alias("late"), F.lit(0).alias("rank"), "key")
    both = named.unionByName(ranking.select("question_id", F.lit(1).alias("late"), "rank", "key"))
    best = both.groupBy("question_id", "key").agg(F.min(F.struct("late", "rank")).alias("at"))
    place = Window.partitionBy("question_id").orderBy("at", "key")
    return best.select("question_id", "key", F.row_number().over(place).cast("int").alias("rank"))


def evidence_rows(dense: DataFrame, graph: DataFrame, mentions: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Documents of each question by four methods: ``(question_id, method, ranked, gold, recall_<k>, complete_<k>)``.

    ``dense`` and ``graph`` are spans' ``(question_id, rank, key)``, of which each
    document counts once; ``mentions(question_id, key)`` are titles that the
    question has; ``gold(question_id, key)``. Methods: dense, title+dense, graph,
    hybrid (both fused). A question that a method finds nothing for has an empty list.
    """
    near, walked = first_per_document(dense), first_per_document(graph)
    fused = reciprocal_rank_fusion(near.withColumn("method", F.lit("dense")).unionByName(walked.withColumn("method", F.lit("graph")))).select("question_id", "key", "rank")
    lists = {"dense": near, "title+dense": titled_first(mentions, near), "graph": walked, "hybrid": fused}
    rows = None
    for method, own in lists.items():
        own = own.select("question_id", F.lit(method).alias("method"), "rank", "key")
        rows = own if rows is None else rows.unionByName(own)
    top = rows.where(F.col("rank") <= max(ks)).groupBy("question_id", "method").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("ranked"))
    wanted = gold.groupBy("question_id").agg(F.array_sort(F.collect_set("key")).alias("gold"))
    methods = F.explode(F.array(*map(F.lit, lists))).alias("method")
    out = wanted.select("question_id", "gold", methods).join(top, ["question_id", "method"], "left")
    found = F.coalesce("ranked", F.slice("gold", F.lit(1), F.lit(0)))
    out = out.select("question_id", "method", found.alias("ranked"), "gold")
    for k in ks:
        hit = F.size(F.array_intersect("gold", F.slice("ranked", F.lit(1), F.lit(k))))
        out = out.withColumn(f"recall_{k}", hit / F.size("gold")).withColumn(f"complete_{k}", (hit == F.size("gold")).cast("double"))
    return out


def searched(rounds: DataFrame, names: DataFrame, dense: DataFrame, most: int) -> DataFrame:
    """One round of named searches: ``rounds(q, query, seen array)`` to ``(q, found array)``, new passages only.

    Passages whose name (``names(key, name)``) is the query come first, then the
    query's ``dense(query, rank, key)``; what was seen doesn't come again, and a
    question that finds nothing new has an empty array, at which its loop ends.
    """
    exact = rounds.join(names, F.lower("query") == F.lower("name")).select("q", "key", F.lit(0).alias("rank"))
    near = rounds.join(dense, "query").select("q", "key", "rank")
    best = exact.union(near).groupBy("q", "key").agg(F.min("rank").alias("rank"))
    fresh = best.join(rounds.select("q", F.explode("seen").alias("key")).distinct(), ["q", "key"], "left_anti")
    place = Window.partitionBy("q").orderBy("rank", "key")
    few = fresh.withColumn("n", F.row_number().over(place)).where(F.col("n") <= most)
    listed = few.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "key"))), lambda x: x["key"]).alias("found"))
    return rounds.select("q", "seen").groupBy("q").agg(F.flatten(F.collect_list("seen")).alias("seen")).join(listed, "q", "left").select("q", F.coalesce("found", F.slice("seen", F.lit(1), F.lit(0))).alias("found"))
