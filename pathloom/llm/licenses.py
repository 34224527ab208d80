"""License scans by diagonal voting.

All rolling word k-grams of all texts are joined, by their hash and then their
words, to the positions of the same k-grams in the templates. Hits of one
template on one diagonal (text position less template position) vote for a copy
there, each template position once. A diagonal with more votes than its
neighbours is merged with them, as small edits make them, and the span is
verified: hits whose positions rise in both the text and the template are
aligned, and each word between them that has no counterpart costs one. Short
templates must be there as they are, since a word more or less makes them name
another license. Copies of different labels that overlap compete: the best
aligned one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .notices import NOTICES
from .scratch import settle

#: Phrases that count wherever their words stand consecutively.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Grams of these words alone hit almost any text, so pairs of a text and a template go on only if hits can make a copy.
_COMMON = frozenset("a an and any are as be by for from in is it of on or that the this to under with you".split())
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class LicenseConfig:
    k: int = 2
    #: Diagonals so far from the one with most votes belong to its copy.
    drift: int = 3
    #: Least share of a template's words that a copy has, less one for each word that doesn't belong.
    min_share: float = 0.6
    #: Templates of fewer words must be whole.
    short_words: int = 20
    #: Template positions up to this number are broadcast (about 100 bytes each); more are shuffled.
    broadcast_grams: int = 200_000


def default_templates(spark: SparkSession) -> DataFrame:
    """The notices of this package: ``(label, text)``."""
    return spark.createDataFrame(list(NOTICES), "label string, text string")


def template_grams(spark: SparkSession, templates: DataFrame | None, config: LicenseConfig) -> DataFrame:
    """Positions of all k-grams of the phrases and the templates."""
    phrases = spark.createDataFrame(list(PHRASES), "label string, text string").withColumn("exact", F.lit(True))
    own = default_templates(spark) if templates is None else templates.select(F.col("label").cast("string").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    both = phrases.unionByName(own.withColumn("exact", F.lit(False))).distinct()
    words = both.withColumn("template", F.xxhash64("exact", "label", "text")).withColumn("list", words_of(F.col("text")))
    gram = F.transform(F.slice("list", F.lit(1), F.greatest(F.lit(0), F.size("list") - (config.k - 1))), lambda w, i: F.slice("list", i + 1, F.lit(config.k)))
    placed = words.select("template", "label", "exact", F.size("list").alias("words"), F.posexplode(gram).alias("place", "own"))
    return placed.select("template", "label", "exact", "words", "place", F.array_join("own", " ").alias("gram")).withColumn("key", F.xxhash64("gram"))


def words_of(text: Column) -> Column:
    """Words, A-Z lower-cased: runs of ASCII letters and digits and of all other characters."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, _GAPS), lambda w: w != "")


def aligned(hits: list[tuple[int, int]], words: int, k: int) -> tuple[int, int, int]:
    """Least cost of an alignment by hits (pos, place) that rise in both, with its first and end word.

    Words between two hits that follow each other cost the larger of the two
    gaps' sizes, those of the template before the first and after the last one each.
    """
    hits = sorted(set(hits))
    best: list[tuple[int, int]] = []
    done = (words + 1, 0, 0)
    for n, (pos, place) in enumerate(hits):
        cost, first = place, pos
        for (p, q), (c, f) in zip(hits, best):
            if p < pos and q < place:
                gaps = max(pos - p - k, place - q - k, 0)
                # an overlap of the k-grams in one sequence but not in the other is an edit as well
                own = max(gaps, abs((pos - p) - (place - q)))
                if c + own < cost:
                    cost, first = c + own, f
        best.append((cost, first))
        done = min(done, (cost + words - place - k, first, pos + k))
    return done


def _verify(config: LicenseConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words").to_pylist()
            near = batch.column("near").to_pylist()
            found = []
            for n, votes in zip(words, near):
                hits = [(v["diagonal"] + place, place) for v in votes for place in v["places"]]
                cost, first, end = aligned(hits, n, config.k)
                good = cost == 0 if n < config.short_words else cost <= (1 - config.min_share) * n + 1e-9
                found.append((max(0.0, 1.0 - cost / n) if good else -1.0, first, end))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.float64(), pa.int32(), pa.int32()))]
            yield pa.record_batch([batch.column("row"), batch.column("label"), batch.column("words"), *columns], names=["row", "label", "words", "share", "first", "end"])

    return run


def best_copies(copies: list[dict]) -> tuple[list[str], float]:
    """Labels, and the largest share, of the copies that overlap no better one of another label.

    Better is the larger share, then the longer template, then the earlier place.
    Each word belongs to one label, so the work is in proportion to the copies' words.
    """
    held: dict[int, str] = {}
    labels, share = set(), 0.0
    for c in sorted(copies, key=lambda c: (-c["share"], -c["words"], c["first"], c["label"])):
        if all(held.get(at, c["label"]) == c["label"] for at in range(c["first"], c["end"])):
            held.update(dict.fromkeys(range(c["first"], c["end"]), c["label"]))
            labels.add(c["label"])
            share = max(share, c["share"])
    return sorted(labels), share


def _compete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [best_copies(c) for c in batch.column("copies").to_pylist()]
        yield pa.record_batch([batch.column("row"), pa.array([d[0] for d in done], pa.list_(pa.string())), pa.array([d[1] for d in done], pa.float64())], names=["row", "copied", "share"])


def scan_licenses(documents: DataFrame, config: LicenseConfig = LicenseConfig(), templates: DataFrame | None = None) -> DataFrame:
    """``documents(doc_id, text)`` to words, phrase places, labels and a score, a row each.

    ``templates(label, text)`` are the notices to look for (this package's, if
    none are given). ``n_base``, ``first_word`` and ``last_word`` are over the
    phrases' places (null if there is none); ``score`` is the largest verified
    share of any template that has a copy, a half where there are phrases alone,
    else 0. A null or empty text has no
    words. Repeated rows each get their row; other columns take no part; an
    empty table gives none.
    """
    spark = documents.sparkSession
    row = F.monotonically_increasing_id().alias("row")
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"), row)
    # a document's own entry, with its number of words, goes along with its grams
    gram = lambda w, i: F.struct(i.alias("pos"), F.array_join(F.slice("words", i + 1, F.lit(config.k)), " ").alias("gram"))
    count = F.greatest(F.size("words") - (config.k - 1), F.lit(0))
    own = F.array(F.struct(F.size("words").alias("pos"), F.lit(None).cast("string").alias("gram")))
    rolled = slim.select("row", "doc_id", F.explode(F.concat(own, F.transform(F.slice("words", F.lit(1), count), gram))).alias("g")).select("row", "doc_id", "g.pos", "g.gram")
    known = settle(template_grams(spark, templates, config))
    zero = {"key": "long", "place": "int"}
    marker = spark.range(1).select(*((F.lit(0).cast(zero[c]) if c in zero else F.lit(None).cast(known.schema[c].dataType)).alias(c) for c in known.columns))
    table = known.unionByName(marker).withColumnRenamed("gram", "known")
    if known.count() <= config.broadcast_grams:
        table = F.broadcast(table)
    keyed = rolled.withColumn("key", F.when(F.col("gram").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("gram")))
    hits = keyed.join(table, (keyed["key"] == table["key"]) & keyed["gram"].eqNullSafe(table["known"])).select("row", "doc_id", "pos", "template", "label", "exact", "words", "place")
    votes = settle(
        hits.groupBy("row", "doc_id", "template", "label", "exact", "words", (F.col("pos") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"))
        .withColumn("votes", F.size("places"))
    )
    # most texts hit a template by common words alone: hits at too few of its places can't make a copy,
    # and one that must be whole has all its places on a diagonal
    enough = lambda places: F.size(F.array_distinct(F.flatten(places))) * config.k >= F.lit(config.min_share) * F.col("words")
    whole = F.col("votes") == F.col("words") - (config.k - 1)
    voted = votes.where(~F.col("exact") & ((F.col("words") >= config.short_words) | whole))
    likely = voted.groupBy("row", "template", "words").agg(F.collect_list("places").alias("all")).where(enough(F.col("all"))).select("row", "template")
    # the diagonals around each one that has the most votes, the first of equal ones
    around = Window.partitionBy("row", "template").orderBy("diagonal")
    near = around.rangeBetween(-config.drift, config.drift)
    copies = voted.join(likely, ["row", "template"]).select(
        "row",
        "label",
        "words",
        F.collect_list(F.struct("diagonal", "places")).over(near).alias("near"),
        (F.col("votes") == F.max("votes").over(near)).alias("top"),
        (F.col("votes") > F.coalesce(F.max("votes").over(around.rangeBetween(-config.drift, -1)), F.lit(0))).alias("first"),
    )
    # each hit covers k words at most: fewer can't make the share
    peaks = copies.where(F.col("top") & F.col("first") & enough(F.col("near.places")))
    verified = peaks.mapInArrow(_verify(config), "row long, label string, words int, share double, first int, end int").where("share >= 0")
    gathered = verified.groupBy("row").agg(F.collect_list(F.struct("label", "words", "share", "first", "end")).alias("copies"))
    by_template = gathered.mapInArrow(_compete, "row long, copied array<string>, share double")
    base = F.col("exact") & whole
    phrases = votes.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template").isNull(), F.col("diagonal"))).cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base"),
    )
    labels = lambda found: F.array_join(F.array_sort(found), ",")
    none = F.array().cast("array<string>")
    return phrases.join(by_template, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        labels(F.col("base")).alias("base_labels"),
        labels(F.array_union("base", F.coalesce("copied", none))).alias("labels"),
        F.coalesce("share", F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
