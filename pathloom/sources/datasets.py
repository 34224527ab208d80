"""Question sets and their graphs from files in the shapes of public benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import derived_id, snake
from ..operators.lineage import settled

_RECORD = r"^[mg]\."


def bar_triples(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``a|b|c`` with three non-empty parts, each triple once."""
    parts = spark.read.text(path).select(F.split("value", r"\|").alias("p")).where("size(p) = 3")
    rows = parts.select(*(F.trim(F.col("p")[i]).alias(c) for i, c in enumerate(("subject", "relation", "object"))))
    return rows.where("subject <> '' and relation <> '' and object <> ''").distinct()


def bracket_questions(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``question with [topic]<tab>answer|answer``."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"), F.monotonically_increasing_id().alias("id")).where("size(p) = 2")
    return parts.select("id", F.regexp_replace(F.col("p")[0], r"[\[\]]", "").alias("question"), F.regexp_extract(F.col("p")[0], r"\[([^\]]*)\]", 1).alias("topic"), F.split(F.col("p")[1], r"\|").alias("answers"))


def evidence_records(records: DataFrame, kinds: tuple[str, ...] = ("compositional", "inference")) -> tuple[DataFrame, DataFrame]:
    """``records(_id, type, question, answer, evidences)``: the pooled triples of all, the questions of some kinds."""
    triples = records.select(F.explode("evidences").alias("e")).select(F.col("e")[0].alias("subject"), snake(F.col("e")[1]).alias("relation"), F.col("e")[2].alias("object")).distinct()
    questions = records.where(F.col("type").isin(*kinds) & (F.size("evidences") > 0)).select(F.col("_id").alias("id"), "question", F.array("answer").alias("answers"), F.col("evidences")[0][0].alias("gold_start"))
    return triples, questions


def paired_contexts(rows: DataFrame) -> DataFrame:
    """Parallel title and sentence lists as ``context`` pairs."""
    return rows.withColumn("context", F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences")))


def subgraph_questions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(id, question, answer, q_entity, graph)``: each question's own triples, and topics that its graph has."""
    triples = rows.select("id", F.explode("graph").alias("t")).select("id", F.col("t")[0].alias("subject"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("object")).distinct()
    nodes = triples.select("id", F.col("subject").alias("node")).union(triples.select("id", "object")).distinct()
    topics = rows.select("id", F.explode("q_entity").alias("node")).join(nodes, ["id", "node"], "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("node")).alias("start"))
    return triples, rows.select("id", "question", F.col("answer").alias("answers")).join(topics, "id")


def typed(triples: DataFrame) -> DataFrame:
    """Record nodes, whose names are only ids, as a type of their own."""
    kind = lambda c: F.when(F.col(c).rlike(_RECORD), "record").otherwise("entity")
    return triples.withColumn("subject_type", kind("subject")).withColumn("object_type", kind("object"))


def union_graph(triples: DataFrame) -> DataFrame:
    """One graph of all questions' subgraphs."""
    return triples.select("subject", "relation", "object").distinct()


def alias_of(name: Column, salt: str = "") -> Column:
    """The alias of an entity's name; numbers and record ids stay."""
    keep = name.rlike(r"^[0-9.,:-]+$") | name.rlike(_RECORD)
    return F.when(keep, name).otherwise(derived_id("Entity ", 6, F.lit(salt), name))


def anonymised(triples: DataFrame, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """Entities under aliases; numbers and record ids stay. Returns the triples and ``(name, alias)``."""
    names = triples.select(F.col("subject").alias("name")).union(triples.select("object")).distinct()
    aliases = names.select("name", alias_of(F.col("name"), salt).alias("alias"))
    out = triples.join(aliases.withColumnsRenamed({"name": "subject", "alias": "s"}), "subject").join(aliases.withColumnsRenamed({"name": "object", "alias": "o"}), "object")
    return out.select(F.col("s").alias("subject"), "relation", F.col("o").alias("object")), aliases


#: Words and what stands between them, in turn.
_PIECES = r"(?U)(\w+|\W+)"


def anonymised_questions(questions: DataFrame, names: DataFrame, salt: str = "", least: int = 4) -> DataFrame:
    """``questions(q, question, start)`` with the names in them under aliases: ``(q, question, start, topic_in_question)``.

    ``start`` is an array of topic names, which are replaced wherever they stand,
    the longest first, whatever the case; ``topic_in_question`` says whether all
    were found. Then names of ``names(name)``, or of ``names(q, name)`` where each
    question has its own, are replaced where they stand as whole words and have
    ``least`` characters: at each word the longest name that begins there, from
    the left, no two overlapping; of names that differ in case alone the smallest
    gives the alias. Runs of words are joined with the names by their text, so a
    question meets only names that it has. A null question stays null; null
    names are none.
    """
    longest = F.reverse(F.array_sort(F.transform(F.array_compact(F.coalesce("start", F.array().cast("array<string>"))), lambda s: F.struct(F.length(s).alias("n"), s.alias("name")))))
    literal = lambda name: F.concat(F.lit("(?iu)"), F.regexp_replace(name, r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
    step = lambda acc, s: F.struct(F.regexp_replace(acc["text"], literal(s["name"]), alias_of(s["name"], salt)).alias("text"), (acc["found"] & F.rlike(acc["text"], literal(s["name"]))).alias("found"))
    topic = questions.select("q", "start", F.aggregate(longest, F.struct(F.col("question").alias("text"), F.lit(True).alias("found")), step).alias("t"))
    row = topic.select(F.monotonically_increasing_id().alias("row"), "q", F.transform("start", lambda s: alias_of(s, salt)).alias("start"), F.col("t.text").alias("text"), F.col("t.found").alias("found"), F.regexp_extract_all("t.text", F.lit(_PIECES), F.lit(1)).alias("pieces"))
    rows = settled(row)

    own = ["q"] if "q" in names.columns else []
    known = names.where((F.length("name") >= least) & (alias_of(F.col("name"), salt) != F.col("name")) & F.col("name").rlike(r"(?U)^\w(.*\w)?$"))
    known = known.groupBy(*own, F.lower("name").alias("key")).agg(F.min("name").alias("name"))
    known = known.select(*own, "key", alias_of(F.col("name"), salt).alias("alias"), F.size(F.regexp_extract_all("name", F.lit(_PIECES), F.lit(1))).alias("size"))
    known = settled(known)
    sizes = [r["size"] for r in known.select("size").distinct().orderBy("size").collect()]
    if not sizes:
        return rows.select("q", F.col("text").alias("question"), "start", F.col("found").alias("topic_in_question"))
    run = lambda i, n: F.struct((i + 1).alias("at"), F.lit(n).alias("size"), F.lower(F.array_join(F.slice("pieces", i + 1, F.lit(n)), "")).alias("key"))
    at_words = lambda n: lambda p, i: F.when((i + n <= F.size("pieces")) & p.rlike(r"(?U)^\w"), run(i, n))
    runs = F.concat(*(F.transform("pieces", at_words(n)) for n in sizes))
    spoken = rows.select("row", *own, F.explode(F.array_compact(runs)).alias("r")).select("row", *own, "r.*")
    met = spoken.join(known, [*own, "key", "size"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("size")).alias("less"), "alias"))).alias("met"))

    between = lambda low, high: F.array_join(F.slice("pieces", low, high - low), "")
    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("out"))
    take = lambda acc, m: F.when(m["at"] < acc["next"], acc).otherwise(F.struct((m["at"] - m["less"]).alias("next"), F.concat(acc["out"], between(acc["next"], m["at"]), m["alias"]).alias("out")))
    rest = lambda acc: F.concat(acc["out"], between(acc["next"], F.size("pieces") + 1))
    new = F.when(F.col("met").isNull(), F.col("text")).otherwise(F.aggregate("met", start, take, rest))
    return rows.join(met, "row", "left").select("q", new.alias("question"), "start", F.col("found").alias("topic_in_question"))


def fanout_pages(questions: DataFrame, most: int = 8) -> DataFrame:
    """``questions(id, decomposition)`` (JSON text) to ``(id, place, page, title)``: the evidence pages in order, each once.

    Parts of a decomposition have evidence and further parts, depth first; pages
    without a number are none. Levels beyond ``most`` don't occur.
    """
    kind = "array<struct<evidence:struct<pageid:string,revid:string,title:string>,decomposition:string>>"
    level = questions.select("id", F.array().cast("array<int>").alias("way"), F.col("decomposition").alias("parts"))
    found = None
    for _ in range(most):
        parts = level.select("id", "way", F.posexplode(F.from_json("parts", kind)).alias("i", "part"))
        here = parts.select("id", F.concat("way", F.array(F.col("i").cast("int"))).alias("way"), "part.*")
        found = here if found is None else found.unionByName(here)
        level = here.where("decomposition is not null").select("id", "way", F.col("decomposition").alias("parts"))
    page = found.select("id", "way", F.col("evidence.pageid").alias("page"), F.col("evidence.revid").alias("rev"), F.col("evidence.title").alias("title"))
    first = page.where("page rlike '^[0-9]+$' and rev rlike '^[0-9]+$'").groupBy("id", "page").agg(F.min(F.struct("way", "title")).alias("f"))
    place = Window.partitionBy("id").orderBy("f.way")
    return first.select("id", F.row_number().over(place).alias("place"), "page", F.col("f.title").alias("title"))


def fanout_contexts(pages: DataFrame, corpus: DataFrame, most: int) -> DataFrame:
    """``pages(id, place, page)`` with the texts of ``corpus(page, title, text)``, cut to so many characters."""
    return pages.select("id", "place", "page").join(corpus, "page").select("id", "place", "title", F.left("text", F.lit(most)).alias("text"))
