"""Text into the graph: ledger, extraction clean-up, routing of mentions, schema mapping, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, entity_id, name_key_sql, snake, tokens
from .lineage import first_rows, settled

#: The relations that free-form ones are mapped to.
SCHEMA_RELATIONS = (
    "father mother child spouse sibling relative director producer screenwriter cast_member performer "
    "composer author publisher production_company genre based_on place_of_birth place_of_death "
    "place_of_burial residence country_of_citizenship educated_at employer member_of position_held "
    "occupation award_received nominated_for founded_by owned_by headquarters located_in country "
    "capital part_of follows instance_of"
).split()
OTHER = "OTHER"
GENERIC_TYPE = "entity"

EXTRACTION = "struct<entities:array<struct<name:string,type:string,description:string>>,relations:array<struct<source:string,type:string,target:string,evidence:string>>>"


def document_hash(title: Column, text: Column, version: str) -> Column:
    return content_hash(F.to_json(F.struct(text.alias("text"), title.alias("title"), F.lit(version).alias("version"))))


def ledger_diff(documents: DataFrame, ledger: DataFrame) -> DataFrame:
    """``documents(key, hash)`` against ``ledger(key, hash)``: ``(key, state)``.

    new, changed and unchanged documents, and removed ones that only the ledger has.
    """
    both = documents.select("key", F.col("hash").alias("now")).join(ledger.select("key", F.col("hash").alias("was")), "key", "full")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return both.select("key", state.alias("state"))


def parse_extractions(replies: DataFrame) -> DataFrame:
    """``replies(chunk, reply)``: the outermost braces as an extraction; null where they don't parse."""
    body = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    return replies.select("chunk", F.from_json(body, EXTRACTION).alias("x"))


def clean_extractions(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions ``(chunk, ord, key, name, type)`` and facts ``(chunk, source, type, target, evidence)`` between them.

    Mentions of one key in a chunk are one, with the first name and type; facts
    need both ends among the chunk's mentions and don't lead to themselves.
    """
    entities = parsed.select("chunk", F.posexplode("x.entities").alias("ord", "e")).select("chunk", "ord", name_key_sql(F.col("e.name")).alias("key"), F.trim("e.name").alias("name"), snake(F.coalesce("e.type", F.lit(GENERIC_TYPE))).alias("type")).where("key <> ''")
    mentions = entities.groupBy("chunk", "key").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name"), F.min_by("type", "ord").alias("type"))
    facts = parsed.select("chunk", F.explode("x.relations").alias("r")).select("chunk", name_key_sql(F.col("r.source")).alias("source"), snake(F.col("r.type")).alias("type"), name_key_sql(F.col("r.target")).alias("target"), F.col("r.evidence").alias("evidence"))
    keys = mentions.select("chunk", "key")
    known = facts.where("source <> target and type <> ''").join(keys.withColumnRenamed("key", "source"), ["chunk", "source"], "left_semi").join(keys.withColumnRenamed("key", "target"), ["chunk", "target"], "left_semi")
    return mentions, known.select("chunk", "source", "type", "target", "evidence").distinct()


def route_by_name(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """``mentions(document, key, name, type)`` to ``(…, node, created)``.

    A name that exactly one node has leads there; others make a node of their
    own, one for each document, name and type.
    """
    single = names.groupBy("key").agg(F.min("id").alias("node"), F.countDistinct("id").alias("n")).where("n = 1").select("key", "node")
    fresh = entity_id(F.col("document"), F.col("key"), F.col("type"))
    return mentions.join(single, "key", "left").select("document", "key", "name", "type", F.coalesce("node", fresh).alias("node"), F.col("node").isNull().alias("created"))


def route_windows(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """``mentions(window, document, key, name, type)`` routed window by window: the graph grows in between.

    A window is routed on the names of the graph and of the windows before it.
    New mentions of one key and type in a window lead to one node, the first
    document's. Windows are micro-batches, so their numbers are few.
    """
    known, out = names.select("id", "key"), None
    for window in [r[0] for r in mentions.select("window").distinct().orderBy("window").collect()]:
        routed = route_by_name(mentions.where(F.col("window") == window), known)
        first = routed.where("created").groupBy("key", "type").agg(F.min_by("node", F.struct("document", "node")).alias("first"), F.min("document").alias("by"))
        joined = routed.join(first, ["key", "type"], "left")
        node = F.when(F.col("created"), F.col("first")).otherwise(F.col("node"))
        own = settled(joined.select("document", "key", "name", "type", node.alias("node"), (F.col("created") & (F.col("document") == F.col("by"))).alias("created")).withColumn("window", F.lit(window)))
        known = known.unionByName(own.where("created").select(F.col("node").alias("id"), "key").distinct())
        out = own if out is None else out.unionByName(own)
    return out if out is not None else route_by_name(mentions, names).withColumn("window", F.lit(0))


def routing_candidates(mentions: DataFrame, names: DataFrame, limit: int = 8, max_df: int = 200) -> DataFrame:
    """``mentions(m, key)`` to ``(m, id, score, rank)``: exact keys first, then by Jaccard of name words.

    Words that more than ``max_df`` names have open no pool, unless the mention
    has no rarer one: then the rarest that any name has does. Names are scored
    once, however many nodes have them and mentions ask for them.
    """
    named = names.select("id", "key").distinct()
    words = lambda c: F.array_distinct(tokens(F.col(c)))
    # a node in the result has fewer than ``limit`` nodes before it, each with a few names at most
    variants = named.groupBy("id").agg(F.count("*").alias("v")).agg(F.coalesce(F.max("v"), F.lit(1))).first()[0]
    most = limit * variants
    nodes = first_rows(named, ["key"], ["id"], limit).select("key", "id")
    df = named.select("id", F.explode(words("key")).alias("word")).groupBy("word").agg(F.countDistinct("id").alias("df"))
    keyed = settled(named.groupBy("key").agg(F.min("id").alias("first")).select("key", "first", words("key").alias("words")).withColumn("size", F.size("words")))
    posted = keyed.select("key", "first", "words", "size", F.explode("words").alias("word"))
    asked = mentions.select(F.col("key").alias("mkey")).distinct()
    rarest = Window.partitionBy("mkey").orderBy("df", "word")
    ranked = asked.select("mkey", words("mkey").alias("mwords")).select("mkey", "mwords", F.explode("mwords").alias("word")).join(df, "word").withColumn("n", F.row_number().over(rarest))
    opening = settled(ranked.where((F.col("df") <= max_df) | (F.col("n") == 1)))
    few = opening.where(F.col("df") <= max_df).join(posted.select("word", "key", "first", "words"), "word")
    # a common word lists its shortest names, which are the best of those that share nothing else
    wide = opening.where(F.col("df") > max_df)
    short = first_rows(posted, ["word"], ["size", "first", "key"], most + 1).select("word", "key", "first", "words")
    shared = F.size(F.array_intersect("mwords", "words"))
    jaccard = shared / (F.size("mwords") + F.size("words") - shared)
    scored = lambda pairs: pairs.where("key <> mkey").select("mkey", "key", "first", jaccard.alias("score")).distinct()
    pool = settled(scored(few).unionByName(scored(wide.join(short, "word"))).distinct())
    # of the others those that share more words and whose size allows the score that the lists have secured
    held = first_rows(pool, ["mkey"], [F.desc("score"), "first", "key"], most).groupBy("mkey").agg(F.when(F.count("*") == most, F.min("score")).otherwise(0.0).alias("held"))
    left = wide.join(held, "mkey", "left").fillna({"held": 0.0}).select("mkey", "mwords", F.col("word").alias("opened"), "held")
    least, largest = F.least(F.size("mwords"), F.col("size")), F.greatest(F.size("mwords"), F.col("size"))
    fits = (F.col("opened") == F.col("word")) & (least >= F.col("held") * largest - 1e-9) & (shared > 1)
    more = scored(left.join(posted, fits)).join(pool.select("mkey", "key"), ["mkey", "key"], "left_anti")
    near = first_rows(pool.unionByName(more), ["mkey"], [F.desc("score"), "first", "key"], most, "r")
    lexical = near.join(nodes, "key").select("mkey", "id", "score")
    exact = asked.join(nodes, F.col("mkey") == F.col("key")).select("mkey", "id", F.lit(2.0).alias("score"))
    best = exact.unionByName(lexical).groupBy("mkey", "id").agg(F.max("score").alias("score"))
    few = best.withColumn("r", F.row_number().over(Window.partitionBy("mkey").orderBy(F.desc("score"), "id"))).where(F.col("r") <= limit)
    each = mentions.select("m", F.col("key").alias("mkey")).join(few, "mkey").groupBy("m", "id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("m").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= limit)


def routed(candidates: DataFrame, min_probability: float = 0.6) -> DataFrame:
    """``candidates(m, id, p)``, id null for a new node: the choice, if it is sure enough."""
    order = F.struct((-F.col("p")).alias("k"), F.col("id").isNull().alias("new"), F.col("id"))
    best = candidates.groupBy("m").agg(F.min_by(F.struct("id", "p"), order).alias("b"))
    return best.select("m", F.col("b.id").alias("id"), F.col("b.p").alias("p"), (F.col("b.p") < min_probability).alias("unsure"))


def completed(chunks: DataFrame) -> DataFrame:
    """``chunks(document, applied)``: a document is done when all its chunks are."""
    return chunks.groupBy("document").agg(F.bool_and("applied").alias("done"), F.count("*").alias("chunks"))


def relation_examples(triples: DataFrame, examples: int = 3) -> DataFrame:
    """Distinct relations with their counts and some examples, for a decider to map."""
    place = Window.partitionBy("type").orderBy("source", "target")
    counts = triples.groupBy("type").agg(F.count("*").alias("n"))
    few = triples.withColumn("i", F.row_number().over(place)).where(F.col("i") <= examples)
    shown = few.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "source", "target"))), lambda x: F.concat(x["source"], F.lit(" -> "), x["target"])).alias("examples"))
    return counts.join(shown, "type")


def schema_mapping(decided: DataFrame, min_probability: float = 0.5) -> DataFrame:
    """``decided(type, choice, reversed, p)``: relations that are mapped with enough certainty, OTHER apart."""
    place = Window.partitionBy("type").orderBy(F.desc("p"), "choice")
    best = decided.withColumn("n", F.row_number().over(place)).where("n = 1")
    return best.where((F.col("p") >= min_probability) & (F.col("choice") != OTHER)).select("type", F.col("choice").alias("new_type"), "reversed")


def triple_recall(gold: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """``gold(question_id, source, target)`` names: ``(question_id, source, target, found)`` by an edge either way."""
    keyed = names.select("key", "id").distinct()
    ends = (
        gold.select("question_id", "source", "target")
        .join(keyed.withColumnsRenamed({"key": "source", "id": "a"}), "source", "left")
        .join(keyed.withColumnsRenamed({"key": "target", "id": "b"}), "target", "left")
    )
    pairs = edges.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"), F.lit(True).alias("hit")).distinct()
    both = ends.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(pairs, ["lo", "hi"], "left")
    return both.groupBy("question_id", "source", "target").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("found"))


def chain_recall(found: DataFrame) -> DataFrame:
    return found.groupBy("question_id").agg(F.avg(F.col("found").cast("double")).alias("recall"), F.bool_and("found").alias("complete"))
