"""Where in the sources an answer stands: chunks, dense and graph spans, fusion, reading."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash, snippet
from .cells import in_cells, open_cells, search
from .decide import hash_embed


#: Ends of paragraphs, and of sentences inside them.
_GAP = re.compile(r"(?<=[.!?])\s+|\n\s*\n")


def _sentences(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each paragraph's sentences, from one scan over the gaps between them."""
    paragraphs, at = [[]], 0
    gaps = [(m.start(), m.end(), re.search(r"\n\s*\n", m[0]) is not None) for m in _GAP.finditer(text)]
    for start, end, new in [*gaps, (len(text), len(text), True)]:
        own = text[at:start]
        left = at + len(own) - len(own.lstrip())
        if own.strip():
            paragraphs[-1].append((left, left + len(own.strip())))
        if new:
            paragraphs.append([])
        at = end
    return [p for p in paragraphs if p]


def chunk_spans(text: str, limit: int) -> list[list[tuple[int, int]]]:
    """Chunks as lists of exact document spans, whose texts join with two characters between them.

    A paragraph is one span if it fits the limit, else its sentences are, the
    longer ones cut hard. Spans fill a chunk as long as it stays in the limit.
    """
    spans = []
    for sentences in _sentences(text):
        whole = (sentences[0][0], sentences[-1][1])
        fits = whole[1] - whole[0] <= limit
        spans += [whole] if fits else [(at, min(at + limit, end)) for start, end in sentences for at in range(start, end, limit)]
    chunks, room = [], 0
    for start, end in spans:
        size = end - start + 2
        if size <= room:
            chunks[-1].append((start, end))
        else:
            chunks.append([(start, end)])
            room = limit + 2
        room -= size
    return chunks


def chunked(documents: DataFrame, limit: int = 800) -> DataFrame:
    """``documents(key, text)`` to ``(key, chunk, pieces array<struct<start,end>>, text)``."""
    kind = dict(documents.dtypes)["key"]

    def run(batches):
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["key"], pdf["text"]):
                for i, spans in enumerate(chunk_spans(text or "", limit)):
                    rows.append((key, i, [{"start": a, "end": b} for a, b in spans], "\n\n".join(text[a:b] for a, b in spans)))
            yield pd.DataFrame(rows, columns=["key", "chunk", "pieces", "text"])

    return documents.select("key", "text").mapInPandas(run, f"key {kind}, chunk int, pieces array<struct<start:int,end:int>>, text string")


def chunk_to_document(pieces: Column, start: Column, end: Column) -> Column:
    """A span of a chunk as the document's, snapped to pieces where it falls on a joint."""
    sized = F.transform(pieces, lambda p: F.struct(p["start"].alias("s"), (p["end"] - p["start"]).alias("n")))
    none = F.array().cast("array<struct<at:int,s:int,n:int>>")
    placed = F.aggregate(sized, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, p: F.struct((a["at"] + p["n"] + 2).cast("int").alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].cast("int").alias("at"), p["s"].cast("int").alias("s"), p["n"].cast("int").alias("n")))).alias("out")), lambda a: a["out"])
    hit = F.filter(placed, lambda p: (p["at"] < end) & (start < p["at"] + p["n"]))
    first, last = F.try_element_at(hit, F.lit(1)), F.try_element_at(hit, F.lit(-1))
    low = first["s"] + F.greatest(F.lit(0), start - first["at"])
    high = last["s"] + F.least(last["n"], end - last["at"])
    return F.when(F.size(hit) > 0, F.struct(low.alias("start"), high.alias("end")))


def evidence_start(text: Column, quote: Column) -> Column:
    """Where a quote stands exactly, from 0; null if nowhere or under 4 characters."""
    at = F.instr(text, quote)
    return F.when((F.length(quote) >= 4) & (at > 0), at - 1)


def _bare(quote: str | None) -> str:
    return re.sub(r"^[\s\"'“”‘’….]+|[\s\"'“”‘’…]+$", "", quote or "")


def folded_evidence(text: str, quote: str) -> tuple[int, int] | None:
    """A quote's span, without regard to case, spacing, outer quotes and ellipses."""
    bare = _bare(quote)
    if len(bare) < 4:
        return None
    at = text.find(bare)
    if at >= 0:
        return at, at + len(bare)
    m = re.search(r"\s+".join(map(re.escape, bare.split())), text, re.I)
    return (m.start(), m.end()) if m else None


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def find_evidence(texts: pd.Series, quotes: pd.Series) -> pd.DataFrame:
    found = [folded_evidence(t or "", q or "") or (None, None) for t, q in zip(texts, quotes)]
    return pd.DataFrame(found, columns=["start", "end"]).astype("Int32")


@F.pandas_udf(T.StringType())
def bare_quote(quotes: pd.Series) -> pd.Series:
    """Quotes without their outer quotes, ellipses and blanks, as ``find_evidence`` looks for them."""
    return quotes.map(_bare)


#: What Python's patterns and split take for white space, as a Java class.
_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]+"


@lru_cache(1)
def _case_pairs() -> tuple[str, str]:
    """Characters that patterns without regard to case take for another one, and that other one."""
    groups: dict[str, list[str]] = {}
    for c in map(chr, range(0x20000)):
        low = c.lower()[0]
        groups.setdefault(low.upper(), []).append(c)
    pairs = [(c, g[0]) for g in groups.values() for c in g[1:]]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def quote_pairs(documents: DataFrame, quotes: DataFrame, most: int = 4) -> DataFrame:
    """``documents(key, text)`` and ``quotes(item, quote)`` to ``(key, item)``: where a quote may stand.

    A quote's inner words are whole words of a text that has it, whatever the
    case and spacing: up to ``most`` of them are an equi-join before the search.
    Quotes of one or two words are joined by their first characters.
    """
    fold = lambda c: F.trim(F.regexp_replace(F.translate(c, *_case_pairs()), _SPACE, " "))
    grams = lambda kind, parts, k: F.transform(F.sequence(F.lit(1), F.size(parts) - k + 1), lambda i: F.xxhash64(F.lit(kind), F.lit(k), F.slice(parts, i, k)))
    asked = quotes.select("item", fold(F.col("quote")).alias("f")).select("item", F.split("f", " ").alias("w"), F.split("f", "").alias("c"))
    worded = F.size("w") > 2
    sized = asked.withColumn("kind", F.when(worded, "word").otherwise("char")).withColumn("k", F.when(worded, F.least(F.size("w") - 2, F.lit(most))).otherwise(F.least(F.size("c"), F.lit(most))))
    first = F.when(worded, F.slice("w", F.lit(2), F.col("k"))).otherwise(F.slice("c", F.lit(1), F.col("k")))
    keyed = sized.select("item", F.xxhash64("kind", "k", first).alias("g")).distinct()
    needed = [(r["kind"], r["k"]) for r in sized.select("kind", "k").distinct().collect() if r["k"] is not None]
    if not needed:
        return documents.select("key").limit(0).crossJoin(quotes.select("item").limit(0))
    parts = documents.select("key", fold(F.col("text")).alias("f")).select("key", F.split("f", " ").alias("w"), F.split("f", "").alias("c"))
    own = [F.when(F.size("w" if kind == "word" else "c") >= k, grams(kind, F.col("w" if kind == "word" else "c"), k)).otherwise(F.array().cast("array<bigint>")) for kind, k in needed]
    docs = parts.select("key", F.explode(F.array_distinct(F.concat(*own))).alias("g"))
    return docs.join(keyed, "g").select("key", "item").distinct()


def overlapping(a_key: Column, a_start: Column, a_end: Column, b_key: Column, b_start: Column, b_end: Column) -> Column:
    """Spans of one document that share a character; one without a span has all of it."""
    whole = a_start.isNull() | b_start.isNull()
    return (a_key == b_key) & (whole | ((a_start < b_end) & (b_start < a_end)))


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``queries(q, v)`` against ``vectors(key, v)``: ``(q, key, score, rank)`` by cosine of unit vectors, ties to smaller keys.

    Exact; vectors are put in cells first, and only cells are opened whose bound allows it.
    """
    return search(queries, in_cells(vectors), k)[0]


def locate_dense(questions: DataFrame, documents: DataFrame, k: int, limit: int = 800) -> DataFrame:
    """``(q, key, chunk, score, rank)``: the chunks closest to each question by the hashing embedder."""
    chunks = chunked(documents, limit).select(F.struct("key", "chunk").alias("key"), hash_embed("text").alias("v"))
    asked = questions.select("q", hash_embed("question").alias("v"))
    return dense_top_k(asked, chunks, k).select("q", "key.key", "key.chunk", "score", "rank")


def walked_spans(answers: DataFrame, provenance: DataFrame) -> DataFrame:
    """``answers(q, answer, hop, edge)`` to the spans of ``provenance(edge, key, start, end, confidence)`` in rank order."""
    place = Window.partitionBy("q").orderBy("answer", "hop", F.desc("confidence"), "key", "start")
    return answers.join(provenance, "edge").withColumn("rank", F.row_number().over(place).cast("int"))


def per_node_spans(spans: DataFrame, limit: int = 3) -> DataFrame:
    """At most so many spans of a node, the most confident."""
    place = Window.partitionBy("node").orderBy(F.desc("confidence"), "key", "start")
    return spans.withColumn("n", F.row_number().over(place)).where(F.col("n") <= limit).drop("n")


def graph_spans(walked: DataFrame, answers: DataFrame, entries: DataFrame, provenance: DataFrame, k: int, per_node: int = 3) -> DataFrame:
    """Spans of the walked edges in hop order, then of the answer nodes, then of the entries: ``(q, rank, key, start, end)``.

    ``walked(q, answer, hop, edge)``, ``answers(q, answer, node)``, ``entries(q,
    ord, node)``, ``provenance(element, key, start, end, confidence)``. At most
    ``per_node`` spans of a node; what overlaps a span taken before is dropped.
    """
    edges = walked_spans(walked, provenance.withColumnRenamed("element", "edge")).select("q", F.lit(0).alias("part"), F.col("rank").alias("a"), F.lit(0).alias("b"), "key", "start", "end")
    of_nodes = per_node_spans(provenance.withColumnRenamed("element", "node"), per_node)
    order = Window.partitionBy("node").orderBy(F.desc("confidence"), "key", "start")
    of_nodes = of_nodes.withColumn("b", F.row_number().over(order))
    nodes = lambda frame, part, a: frame.join(of_nodes, "node").select("q", F.lit(part).alias("part"), F.col(a).cast("int").alias("a"), "b", "key", "start", "end")
    parts = edges.unionByName(nodes(answers, 1, "answer")).unionByName(nodes(entries, 2, "ord"))
    place = Window.partitionBy("q").orderBy("part", "a", "b", "key", "start")
    ranked = parts.withColumn("rank", F.row_number().over(place).cast("int"))
    return select_spans(ranked, k)


def save_vectors(chunks: DataFrame, path: str) -> None:
    """``chunks(key, chunk, text)`` with their vectors in cells as Parquet, to be searched again."""
    chunks.select("key", "chunk", "text").write.parquet(f"{path.rstrip('/')}/texts")
    in_cells(chunks.select(F.struct("key", "chunk").alias("key"), hash_embed("text").alias("v"))).save(path)


def search_vectors(questions: DataFrame, path: str, k: int) -> DataFrame:
    """``questions(q, question)`` against saved vectors: ``(q, key, chunk, text, score, rank)``."""
    spark = questions.sparkSession
    asked = questions.select("q", hash_embed("question").alias("v"))
    near = search(asked, open_cells(spark, path), k)[0].select("q", "key.*", "score", "rank")
    return near.join(spark.read.parquet(f"{path.rstrip('/')}/texts"), ["key", "chunk"])


def select_spans(spans: DataFrame, k: int) -> DataFrame:
    """``spans(q, rank, key, start, end)``: in rank order those that overlap none taken before, at most k."""
    kinds = dict(spans.dtypes)

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = []
        for r in pdf.sort_values("rank").to_dict("records"):
            whole = lambda x: pd.isna(x["start"])
            if not any(t["key"] == r["key"] and (whole(t) or whole(r) or (t["start"] < r["end"] and r["start"] < t["end"])) for t in taken):
                taken.append(r)
            if len(taken) == k:
                break
        return pd.DataFrame(taken, columns=["q", "rank", "key", "start", "end"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("q", "rank", "key", "start", "end"))
    return spans.select("q", "rank", "key", "start", "end").groupBy("q").applyInPandas(take, schema)


def fuse_spans(spans: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of lists of spans: ``spans(q, list, rank, key, start, end)``, ranks from 0.

    A span joins the first group whose head it overlaps, else opens one; a list
    credits a group once.
    """
    kinds = dict(spans.dtypes)

    def fuse(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[dict] = []
        for r in pdf.sort_values(["list", "rank"]).to_dict("records"):
            for g in groups:
                h = g["head"]
                if h["key"] == r["key"] and (pd.isna(h["start"]) or pd.isna(r["start"]) or (h["start"] < r["end"] and r["start"] < h["end"])):
                    break
            else:
                g = {"head": r, "lists": set(), "score": 0.0}
                groups.append(g)
            if r["list"] not in g["lists"]:
                g["lists"].add(r["list"])
                g["score"] += 1.0 / (constant + r["rank"] + 1)
        best = sorted(range(len(groups)), key=lambda i: (-groups[i]["score"], i))[:k]
        rows = [(groups[i]["head"]["q"], n, groups[i]["head"]["key"], groups[i]["head"]["start"], groups[i]["head"]["end"], groups[i]["score"]) for n, i in enumerate(best, 1)]
        return pd.DataFrame(rows, columns=["q", "rank", "key", "start", "end", "score"])

    schema = f"q {kinds['q']}, rank int, key {kinds['key']}, start {kinds['start']}, end {kinds['end']}, score double"
    return spans.groupBy("q").applyInPandas(fuse, schema)


def read_spans(locations: DataFrame, documents: DataFrame, context: int = 0) -> DataFrame:
    """``locations(q, key, start, end, seen_hash)`` with the text as read, and whether the document has changed."""
    rows = locations.join(documents.select("key", F.col("text").alias("_text")), "key")
    size = F.length("_text")
    low = F.greatest(F.lit(0), F.least(F.coalesce("start", F.lit(0)), size) - context)
    high = F.least(size, F.coalesce("end", size) + context)
    stale = F.col("seen_hash").isNotNull() & (F.col("seen_hash") != content_hash(F.col("_text")))
    passage = F.substring("_text", low + 1, high - low)
    return rows.select("q", "key", low.alias("start"), high.alias("end"), passage.alias("passage"), snippet(passage).alias("snippet"), stale.alias("stale"))


def title_mentions(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """``(q, key)`` where the question has the title, but for a trailing parenthesis, as whole words."""
    bare = titles.select("key", F.lower(F.regexp_replace("title", r"\s*\([^)]*\)\s*$", "")).alias("t")).where("length(t) > 0")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.col("t"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    # the first word of a title must be a word of the question: an equi-join before the pattern
    asked = questions.select("q", F.lower("question").alias("text"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("word"))
    keyed = bare.withColumn("word", F.regexp_extract("t", r"[\p{L}\p{N}_]+", 0))
    return asked.join(keyed, "word").where(F.regexp_like("text", pattern)).select("q", "key").distinct()
