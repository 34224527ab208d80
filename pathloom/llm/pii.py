"""Personal data by fixed kinds and bootstrapped contextual extraction.

Spans of the fixed kinds are the seeds. The words around them induce lexical
patterns: one to three words before, one or two after, and the word before
together with the span's shape. Over a graph of patterns and instances Spark
scores both in turn, a pattern by how often it leads to a trusted instance
among all its occurrences in the corpus, an instance by the patterns that lead
to it. What has the form of a fixed kind but fails its check never becomes an
instance and speaks against its patterns. Instances of high confidence that no
fixed kind covers are spans of the kind ``context``. Column expressions and
joins only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import release, settle
from .spans import SPAN, as_spans, count_kind, in_order, joined, luhn, with_masked, with_matches, without_overlaps

#: The kinds in their order. Lookarounds keep long runs linear and
#: leave the leftmost non-overlapping matches as they are.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"

#: A candidate: a run of such characters that has a digit.
_CANDIDATE = r"(?<![A-Za-z0-9._@/#+-])(?=[A-Za-z._@/#+-]*[0-9])[A-Za-z0-9+#@][A-Za-z0-9._@/#+-]{5,}+"
_BLANK = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class PiiConfig:
    rounds: int = 3
    #: A pattern needs so many different instances, and this share of its occurrences must lead to trusted ones.
    min_support: int = 3
    min_precision: float = 0.6
    min_confidence: float = 0.6
    #: Least digits of a candidate.
    min_digits: int = 4
    #: Words before and after a span that make patterns; longer words than ``word`` make none.
    left: int = 3
    right: int = 2
    word: int = 100
    #: Patterns (8 bytes each), or documents with contextual spans, up to this
    #: number are broadcast; more are shuffled.
    broadcast_rows: int = 200_000


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def with_forms(frame: DataFrame, text: str, more: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Columns of the matches of the fixed kinds' forms (``email_form``), of those that
    pass their checks (``email``), and of all the latter as spans (``base``)."""
    of = F.col(text)
    forms = {
        "email_form": (EMAIL, of.contains("@")),
        "ip_form": (IP, of.rlike(r"[0-9]\.[0-9]")),
        "card_form": (CARD, of.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")),
        "phone_form": (PHONE, of.rlike(r"\+[0-9]")),
    }
    found = with_matches(frame, text, forms | (more or {}))
    checked = found.select("*", *(F.filter(f"{k}_form", base_check(k)).alias(k) for k in KINDS))
    return checked.withColumn("base", in_order(*(as_spans(F.col(k), k, i) for i, k in enumerate(KINDS))))


def base_check(kind: str) -> Callable[[Column], Column]:
    """What a match of the kind's form must fulfil."""

    def byte(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return {
        "email": lambda m: F.lit(True),
        "ip": lambda m: F.forall(F.split(m["text"], r"\."), byte),
        "card": lambda m: luhn(_digits(m["text"])),
        "phone": lambda m: F.length(_digits(m["text"])).between(10, 15),
    }[kind]


def _reach(config: PiiConfig) -> int:
    return (config.word + 2) * (max(config.left, config.right) + 1)


def _bare(gap: Column, before: bool) -> Column:
    """A gap without the quotes and stops next to the span."""
    return F.regexp_replace(gap, r"[\"'(\[<]+$" if before else r"^[.,;:!?\"')\]>]+", "")


def _near_words(bare: str, cut: Column, many: int, before: bool) -> Column:
    """The words of a gap next to a span, the nearest first, in lower case."""
    words = F.filter(F.split(F.lower(bare), _BLANK), lambda w: w != "")
    ordered = F.reverse(words) if before else words
    # a word that the reach cuts is none
    whole = F.when(cut, F.slice(ordered, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(ordered)
    touching = F.col(bare).rlike(_BLANK + "$" if before else "^" + _BLANK)
    return F.when(touching, F.slice(whole, F.lit(1), F.lit(many))).otherwise(F.array().cast("array<string>"))


def _usable(word: Column, config: PiiConfig) -> Column:
    return (F.length(word) <= config.word) & ~word.rlike("[0-9]")


def _runs(words: str, before: bool, config: PiiConfig) -> Column:
    """Size and hash of the nearest word, of the nearest two, and so on, in reading order, as far as all are usable."""
    many = config.left if before else config.right
    grams = []
    for n in range(1, many + 1):
        own = F.slice(words, F.lit(1), F.lit(n))
        usable = F.forall(own, lambda w: _usable(w, config)) & (F.size(words) >= n)
        grams.append(F.when(usable, F.struct(F.lit(n).alias("size"), F.xxhash64(F.array_join(F.reverse(own) if before else own, " ")).alias("gram"))))
    return F.array_compact(F.array(*grams))


def _shape(text: Column) -> Column:
    """Runs of capitals, small letters and digits as one sign and their length."""
    shaped = F.translate(F.regexp_replace(F.regexp_replace(text, "[A-Z]", "A"), "[a-z]+", "a"), "012345678", "999999999")
    return F.left(shaped, F.lit(64))


def _with_patterns(slots: DataFrame, config: PiiConfig) -> DataFrame:
    """Slots, a row each, with the patterns around them: the array ``patterns`` of (size, gram, pattern).

    ``gram`` is the hash of the words in reading order, the same wherever they
    stand in a text; shapes have none, as their occurrences are counted among
    the slots.
    """
    bare = slots.withColumn("bare_before", _bare(F.col("before"), True)).withColumn("bare_after", _bare(F.col("after"), False))
    worded = bare.withColumn("left", _near_words("bare_before", F.col("cut_before"), config.left, True)).withColumn("right", _near_words("bare_after", F.col("cut_after"), config.right, False))
    grams = worded.withColumn("left_grams", _runs("left", True, config)).withColumn("right_grams", _runs("right", False, config))
    first = F.get(F.col("left"), 0)
    shape = F.when(_usable(F.coalesce(first, F.lit("0")), config), F.xxhash64(F.lit("shape"), first, _shape(F.col("string"))))
    entry = lambda side: lambda g: F.struct(g["size"].alias("size"), g["gram"].alias("gram"), F.xxhash64(F.lit(side), g["gram"]).alias("pattern"))
    bare_shape = F.transform(F.array_compact(F.array(shape)), lambda p: F.struct(F.lit(None).cast("int").alias("size"), F.lit(None).cast("long").alias("gram"), p.alias("pattern")))
    return grams.withColumn("patterns", F.concat(F.transform("left_grams", entry("left")), F.transform("right_grams", entry("right")), bare_shape))


def _occurrences(texts: DataFrame, asked: DataFrame, sizes: list[int]) -> DataFrame:
    """How often each asked gram stands in the texts: ``(gram, occurrences)``.

    ``sizes`` are the numbers of words that asked grams have. Neighbours come
    from shifted arrays, so that a word is exploded once and hashed without
    being cut out of its text again.
    """
    if not sizes:
        return asked.select("gram", F.lit(0).cast("long").alias("occurrences")).limit(0)
    shifted = ["words", *(F.slice("words", F.lit(n), F.greatest(F.size("words"), F.lit(1))).alias(f"w{n}") for n in range(2, max(sizes) + 1))]
    words = F.filter(F.split(F.lower("text"), _BLANK), lambda w: w != "")
    spoken = texts.select(words.alias("words")).where(F.size("words") > 0).select(F.explode(F.arrays_zip(*shifted)).alias("near")).select("near.*")
    word = lambda n: F.col("words" if n == 1 else f"w{n}")
    gram = lambda n: F.when(word(n).isNotNull(), F.xxhash64(F.concat_ws(" ", *map(word, range(1, n + 1)))))
    grams = spoken.select(F.explode(F.array(*map(gram, sizes))).alias("gram")).where("gram is not null")
    return grams.join(asked, "gram").groupBy("gram").agg(F.count("*").alias("occurrences"))


def _scored(graph: DataFrame, seeds: DataFrame, config: PiiConfig) -> DataFrame:
    """Instances with their confidence after the rounds: ``(instance, confidence)``.

    ``graph(pattern, instance, n, occurrences)``.
    """
    trusted = seeds
    for _ in range(config.rounds):
        patterns = (
            graph.join(trusted, "instance")
            .groupBy("pattern")
            .agg(F.sum(F.col("n") * F.col("confidence")).alias("led"), F.count("*").alias("support"), F.first("occurrences").alias("occurrences"))
            .where(F.col("support") >= config.min_support)
            # rounded, so that the order of a sum decides nothing
            .select("pattern", F.round(F.least(F.lit(1.0), F.col("led") / F.col("occurrences")), 9).alias("precision"))
            .where(F.col("precision") >= config.min_precision)
        )
        found = graph.join(patterns, "pattern").where("can_be").groupBy("instance").agg(F.max("precision").alias("confidence")).where(F.col("confidence") >= config.min_confidence)
        trusted = settle(found.union(seeds).groupBy("instance").agg(F.max("confidence").alias("confidence")))
    return trusted


def find_pii(documents: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """``documents(doc_id, text)`` to ``(doc_id, text_hash, base, spans)``, a row each.

    ``base`` and ``spans`` are arrays of (start, rank, end, kind) by start and
    rank; spans has base and the contextual ones. A null or empty text has
    none. A span's context ends at the next match of its own form. Repeated
    rows each get their row; other columns take no part; an empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    based = with_forms(slim, "text", {"word": (_CANDIDATE, F.col("text").rlike("[0-9]"))})
    reach = _reach(config)

    def slot(m: Column, string: Column, state: Column) -> Column:
        return F.struct(
            m["start"].alias("start"),
            (m["start"] + F.length(string)).cast("int").alias("end"),
            string.alias("string"),
            state.alias("state"),
            F.right(m["before"], F.lit(reach)).alias("before"),
            F.left(m["after"], F.lit(reach)).alias("after"),
            (F.length(m["before"]) > reach).alias("cut_before"),
            (F.length(m["after"]) > reach).alias("cut_after"),
        )

    def tried(kind: str) -> Column:
        check = base_check(kind)
        return F.transform(f"{kind}_form", lambda m: slot(m, m["text"], F.when(check(m), "seed").otherwise("failed")))

    bare = lambda m: F.regexp_replace(m["text"], r"[._@/#+-]+$", "")
    words = based.withColumn("word", F.filter("word", lambda m: F.length(_digits(bare(m))) >= config.min_digits))
    free = words.withColumn("word", without_overlaps("word", *(f"{k}_form" for k in KINDS)))
    candidates = F.transform("word", lambda m: slot(m, bare(m), F.lit("candidate")))
    row = F.monotonically_increasing_id().alias("row")
    found = settle(free.select("doc_id", F.xxhash64("text").alias("text_hash"), "base", F.concat(*map(tried, KINDS), candidates).alias("slots"), row))
    slots = _with_patterns(found.select("row", F.explode("slots").alias("s")).select("row", "s.*"), config)
    slots = settle(slots.select("row", "start", "end", "state", F.xxhash64("string").alias("instance"), "patterns"))
    release(documents.sparkSession)
    led = slots.select("instance", "state", F.explode("patterns").alias("p")).select("instance", "state", "p.*")
    edges = settle(
        led.groupBy("pattern", "instance").agg(F.first("gram").alias("gram"), F.first("size").alias("size"), F.count("*").alias("n"), (F.max(F.when(F.col("state") != "failed", 1)) == 1).alias("can_be"))
    )
    supported = edges.groupBy("pattern").agg(
        F.count(F.when(F.coalesce("can_be", F.lit(False)), 1)).alias("many"), F.sum("n").alias("slots"), F.first("gram").alias("gram"), F.first("size").alias("size")
    )
    supported = settle(supported.where(F.col("many") >= config.min_support))
    asked = settle(supported.where("gram is not null").groupBy("gram").agg(F.first("size").alias("size")))
    many = {r["size"]: r["count"] for r in asked.groupBy("size").count().collect()}
    asked = asked.select("gram")
    if sum(many.values()) <= config.broadcast_rows:
        asked = F.broadcast(asked)
    release(documents.sparkSession)
    occurrences = settle(_occurrences(slim, asked, sorted(many)))
    counted = supported.join(occurrences, "gram", "left").select("pattern", F.greatest("slots", F.coalesce("occurrences", F.lit(0))).alias("occurrences"))
    graph = settle(edges.select("pattern", "instance", "n", F.coalesce("can_be", F.lit(False)).alias("can_be")).join(counted, "pattern"))
    seeds = settle(slots.where("state = 'seed'").select("instance", F.lit(1.0).alias("confidence")).distinct())
    release(documents.sparkSession)
    trusted = _scored(graph, seeds, config)
    release(documents.sparkSession)
    extra = (
        slots.where("state = 'candidate'")
        .join(trusted, "instance")
        .select("row", F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(CONTEXT).alias("kind")).cast(SPAN).alias("span"))
        .groupBy("row")
        .agg(F.collect_list("span").alias("extra"))
    )
    both = in_order(F.col("base"), F.coalesce("extra", F.array().cast(f"array<{SPAN}>")))
    return found.select("row", "doc_id", "text_hash", "base").join(extra, "row", "left").select("doc_id", "text_hash", "base", both.alias("spans"))


def pii_report(documents: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """Counts of each fixed kind, the base spans' digest and all spans as text."""
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return find_pii(documents, config).select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask_pii(documents: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """The documents with each span of their texts replaced by ``[KIND]``, and n_chars brought up to date.

    All columns and rows stay; null texts stay null.
    """
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    extra = find_pii(documents, config).where(F.size("spans") > F.size("base"))
    extra = settle(extra.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), F.col("spans").alias("found_spans")).dropDuplicates(["found_id", "found_hash"]))
    many = extra.count()
    release(documents.sparkSession)
    based = with_forms(documents.select(F.struct("*").alias("document"), text.alias("text")), "text").select("document", "text", "base")
    spans = F.col("base")
    if many:
        same = F.col("document.doc_id").cast("long").eqNullSafe(F.col("found_id")) & (F.xxhash64("text") == F.col("found_hash"))
        based = based.join(F.broadcast(extra) if many <= config.broadcast_rows else extra, same, "left")
        spans = F.coalesce("found_spans", "base")
    new = with_masked(based.select("document", "text", spans.alias("spans")), "text", "spans", "new")
    changed = {
        "text": F.when(F.col("document.text").isNotNull(), F.col("new")),
        "n_chars": F.when(F.size("spans") > 0, F.length("new")).otherwise(F.col("document.n_chars")).cast("long") if "n_chars" in documents.columns else None,
    }
    return new.select(*(changed.get(c, F.col(f"document.`{c}`")).alias(c) for c in documents.columns))
