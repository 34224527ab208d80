"""Entry linking: which nodes a question names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from .decide import hash_embed
from .lineage import first_rows, settled
from .locate import dense_top_k

#: English function words, which alone name nothing.
STOP_WORDS = (
    "a about an and are as at be by did do does for from had has have he her his how i "
    "in is it its me my of on or our s she that the their them they this to was we were "
    "what when where which who whom whose why will with you your"
).split()
_MENTIONS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("key", T.StringType())]))
MAX_WORDS = 12
MIN_NAME = 3


def content_words(text: Column) -> Column:
    stops = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.filter(F.array_distinct(tokens(text)), lambda w: ~F.array_contains(stops, w))


def name_index(names: DataFrame) -> DataFrame:
    """``names(id, name)`` to ``(id, words, key, n)``: names as token runs."""
    words = tokens(F.col("name"))
    return names.where(F.length("name") >= MIN_NAME).select("id", words.alias("words"), F.array_join(words, " ").alias("key"), F.size(words).alias("n")).where("n > 0").distinct()


def exact_candidates(asked: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """``asked(q, key)`` to the first ``most`` entries of its key by id: ``(q, id, rank)``.

    A key's entries are cut before they meet those who ask, so a name that many
    entries and many questions share costs their sum and not their product.
    """
    first = first_rows(index.select("key", "id").distinct(), ["key"], ["id"], most, "rank")
    return asked.join(first, "key").select("q", "id", "rank")


def name_idf(index: DataFrame) -> DataFrame:
    """``ln(1 + N/df)`` over the content words of N names."""
    n = index.select(F.count("*").alias("total"))
    df = index.select(F.explode(content_words(F.col("key"))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("word", "df", F.log(1 + F.col("total") / F.col("df")).alias("idf"))


def ngrams(questions: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """``questions(q, question)`` to all its runs of at most ``most`` tokens: ``(q, pos, n, key)``."""
    positioned = questions.select("q", tokens(F.col("question")).alias("w")).select("q", "w", F.posexplode("w").alias("pos", "first"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - F.col("pos")))
    return positioned.select("q", "w", "pos", F.explode(lengths).alias("n")).select("q", "pos", "n", F.array_join(F.slice("w", F.col("pos") + 1, F.col("n")), " ").alias("key"))


def mention_candidates(questions: DataFrame, index: DataFrame) -> DataFrame:
    """Runs that are a whole name and not all stop words; the longest at each position."""
    known = index.where(F.col("n") <= MAX_WORDS).select("key").distinct()
    good = ngrams(questions).join(known, "key").where(F.size(content_words(F.col("key"))) > 0)
    longest = Window.partitionBy("q", "pos").orderBy(F.desc("n"))
    return good.withColumn("r", F.row_number().over(longest)).where("r = 1").drop("r")


@F.pandas_udf(_MENTIONS)
def _accepted(candidates: pd.Series) -> pd.Series:
    """Of each question's candidates those that overlap none accepted before, longer and then earlier first."""

    def one(rows) -> list[dict]:
        taken: set[int] = set()
        out = []
        for r in sorted(rows, key=lambda r: (-r["n"], r["pos"])):
            own = set(range(r["pos"], r["pos"] + r["n"]))
            if not own & taken:
                taken |= own
                out.append({"pos": r["pos"], "n": r["n"], "key": r["key"]})
        return out

    return candidates.map(one)


def exact_mentions(questions: DataFrame, index: DataFrame) -> DataFrame:
    """Mentions that don't overlap, longer and then earlier ones first, with all their nodes: ``(q, pos, n, id)``.

    Acceptance depends on what was accepted before, so each question's few
    candidates are gone through in a function over arrays.
    """
    row = F.struct(F.col("pos").cast("int").alias("pos"), F.col("n").cast("int").alias("n"), "key")
    listed = mention_candidates(questions, index).groupBy("q").agg(F.collect_list(row).alias("c"))
    kept = listed.select("q", F.explode(_accepted("c")).alias("m")).select("q", "m.*")
    return kept.join(index.select("key", "id").distinct(), "key").select("q", "pos", "n", "id")


def fuzzy_pool(questions: DataFrame, index: DataFrame, idf: DataFrame, most: int) -> DataFrame:
    """Pairs ``(q, key, first, score)``, among them every question's ``most`` best names; ``first`` is a name's smallest node.

    A name that shares one word with a question scores the better the smaller
    its total is, so a list of the word's smallest names has all that can be
    among the best. One that shares several scores at most the sum of the
    question's weights from the rarest of them on: words are opened, the rarest
    first, only as long as that sum reaches the score that the lists have
    secured. So a word that a third of the names have opens next to nothing.
    """
    firsts = index.groupBy("key").agg(F.min("id").alias("first"))
    posted = firsts.select("key", "first", F.explode(content_words(F.col("key"))).alias("word")).join(idf.select("word", "idf", "df"), "word")
    named = settled(posted.groupBy("key", "first").agg(F.sum("idf").alias("total"), F.collect_set("word").alias("words")))
    alone = F.round(F.col("idf") * F.col("idf") / F.col("total"), 9)
    listed = posted.join(named.select("key", "total"), "key").select("word", "key", "first", alone.alias("alone"))
    short = first_rows(listed, ["word"], [F.desc("alone"), "first", "key"], most).select("word", "key")

    asked = questions.select("q", F.explode(content_words(F.col("question"))).alias("word")).join(idf.select("word", "idf", "df"), "word")
    weighted = settled(asked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("idf")).alias("order"), "word", "idf", "df"))).alias("asked")))

    def scored(pairs: DataFrame) -> DataFrame:
        own = F.filter("asked", lambda x: F.array_contains("words", x["word"]))
        shared = F.aggregate(own, F.lit(0.0), lambda s, x: s + x["idf"])
        both = pairs.join(named, "key").join(weighted, "q").withColumn("m", shared)
        return both.select("q", "key", "first", F.round(F.col("m") * F.col("m") / F.col("total"), 9).alias("score"))

    each = weighted.select("q", F.posexplode("asked").alias("i", "x"), "asked")
    near = settled(scored(each.select("q", F.col("x.word").alias("word")).join(short, "word").select("q", "key").distinct()))
    held = first_rows(near, ["q"], [F.desc("score"), "first", "key"], most).groupBy("q").agg(F.when(F.count("*") == most, F.min("score")).otherwise(0.0).alias("held"))
    rest = F.aggregate(F.slice("asked", F.col("i") + 1, F.size("asked")), F.lit(0.0), lambda s, x: s + x["idf"])
    # a word whose names are all listed needn't be opened, nor one after which there is no other
    wide = each.where((F.col("x.df") > most) & (F.col("i") < F.size("asked") - 1)).select("q", F.col("x.word").alias("word"), (rest + 1e-9).alias("rest"), F.transform(F.slice("asked", F.col("i") + 2, F.size("asked")), lambda x: x["word"]).alias("later"))
    opened = wide.join(held, "q").where(F.col("rest") >= F.col("held"))
    names = named.select("key", "total", "words", F.explode("words").alias("word"))
    fits = (opened["word"] == names["word"]) & (F.col("rest") * F.col("rest") >= F.col("held") * F.col("total")) & F.arrays_overlap("later", "words")
    more = opened.join(names, fits).select("q", "key").distinct().join(near.select("q", "key"), ["q", "key"], "left_anti")
    return near.unionByName(scored(more))


def fuzzy_candidates(questions: DataFrame, index: DataFrame, idf: DataFrame, top: int = 8) -> DataFrame:
    """Names by the squared matched share of their words' weights, the best per node: ``(q, id, score, rank)``."""
    # names are scored once, however many nodes have them; a node in the result has
    # fewer than ``top`` nodes before it, each with a few names at most
    variants = index.groupBy("id").agg(F.countDistinct("key").alias("v")).agg(F.coalesce(F.max("v"), F.lit(1))).first()[0]
    names = first_rows(fuzzy_pool(questions, index, idf, top * variants), ["q"], [F.desc("score"), "first", "key"], top * variants, "r")
    nodes = first_rows(index.select("key", "id").distinct(), ["key"], ["id"], top)
    best = names.join(nodes, "key").groupBy("q", "id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= top)


def link(questions: DataFrame, names: DataFrame, entries: int = 2, nearest: bool = False) -> DataFrame:
    """``(q, id, rank)``: exact mentions in their order, else the best fuzzy names.

    With ``nearest`` a question that neither finds anything for gets the name
    whose vector is closest to it.
    """
    index = name_index(names)
    exact = exact_mentions(questions, index).groupBy("q", "id").agg(F.min("pos").alias("pos"))
    place = Window.partitionBy("q").orderBy("pos", "id")
    first = exact.withColumn("rank", F.row_number().over(place).cast("int")).select("q", "id", "rank")
    rest = questions.join(first.select("q").distinct(), "q", "left_anti")
    fuzzy = fuzzy_candidates(rest, index, name_idf(index), entries).select("q", "id", "rank")
    found = first.unionByName(fuzzy).where(F.col("rank") <= entries)
    if not nearest:
        return found
    left = questions.join(found.select("q").distinct(), "q", "left_anti").select("q", hash_embed("question").alias("v"))
    close = dense_top_k(left, names.select(F.col("id").alias("key"), hash_embed("name").alias("v")), 1)
    return found.unionByName(close.select("q", F.col("key").alias("id"), "rank"))
