"""Secrets by fixed kinds and sliding-window entropy of candidate strings.

A window of fixed width slides over each candidate; counts per character are
kept up to date as one character enters and one leaves, and so is the sum that
gives the window's Shannon entropy. Each class of characters has its own
threshold. An allow-list suppresses what merely looks random. Column
expressions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import as_spans, count_kind, fenced, in_order, joined, with_masked, with_matches, without_overlaps

#: The kinds in their order.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex")
ENTROPY = "entropy"

#: Candidates have a digit and a letter.
_CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
#: Strings that look random but are no secrets: samples, dates and UUIDs.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0000000000|1234567890|abcdefgh",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
)
#: Paths, names and codes: all parts between signs are words, perhaps with a short number, or numbers.
_SIGNS = "[/_=+-]+"
PLAIN_PART = r"^(?:(?:[A-Z]?[a-z]{1,14}(?:[A-Z][a-z]{1,14}){0,3}|[A-Z]{1,14})[0-9]{0,4}|[0-9]{0,14})$"
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


@dataclass(frozen=True)
class SecretConfig:
    window: int = 20
    #: Least bits per character in some window: hexadecimal, lower- or upper-case with digits, all.
    hexadecimal: float = 3.0
    single_case: float = 3.6
    mixed: float = 3.8


#: Counters of 5 bits, so many to a 64-bit word.
_PACKED = 12


def alphabet_places(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(_ALPHABET), c) - 1)


def max_window_entropy(places: Column, window: int) -> Column:
    """Largest entropy, in bits per character, of the windows over a string, given by its alphabet places.

    The characters' counts are packed in a few integers, in which the entering
    and the leaving one are changed by position; so a window has at most 31
    characters. 0 for shorter strings.
    """
    if not 0 < window < 32:
        raise ValueError("a window has 1 to 31 characters")
    words = -(-len(_ALPHABET) // _PACKED)
    term = lambda n: n * math.log2(n) if n > 1 else 0.0
    #: How the sum of n * log2(n) changes when a count of n falls, or rises, by one.
    falls = F.array(*(F.lit(term(n) - term(n - 1)) for n in range(33)))
    rises = F.array(*(F.lit(term(n + 1) - term(n)) for n in range(33)))
    zero = F.lit(0).cast("long")

    def unit(place: Column, k: int) -> Column:
        return F.when(F.floor(place / _PACKED) == k, F.call_function("shiftleft", F.lit(1).cast("long"), ((place % _PACKED) * 5).cast("int"))).otherwise(zero)

    def held(state: Column, place: Column) -> Column:
        word = F.coalesce(*(F.when(F.floor(place / _PACKED) == k, state[f"c{k}"]) for k in range(words)))
        return F.call_function("shiftrightunsigned", word, ((place % _PACKED) * 5).cast("int")).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def step(state: Column, i: Column) -> Column:
        enters, leaves = F.get(places, i), F.get(places, i - window)
        out = F.when(i >= window, held(state, leaves)).otherwise(0)
        into = held(state, enters) - F.when((i >= window) & (leaves == enters), 1).otherwise(0)
        total = state["total"] - F.get(falls, out) + F.get(rises, into)
        counts = [(state[f"c{k}"] - F.when(i >= window, unit(leaves, k)).otherwise(zero) + unit(enters, k)).cast("long").alias(f"c{k}") for k in range(words)]
        return F.struct(*counts, total.alias("total"), F.when(i + 1 >= window, F.least(state["least"], total)).otherwise(state["least"]).alias("least"))

    start = F.struct(*(zero.alias(f"c{k}") for k in range(words)), F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least"))
    best = F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step, lambda s: F.lit(math.log2(window)) - s["least"] / window)
    return F.when(F.size(places) >= window, best).otherwise(F.lit(0.0))


def _suspicious(m: Column, config: SecretConfig) -> Column:
    text = m["text"]
    least = (
        F.when(text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), config.hexadecimal)
        .when(text.rlike("^(?:[^A-Z]+|[^a-z]+)$"), config.single_case)
        .otherwise(config.mixed)
    )
    # sums of rounded logarithms: a window right at the threshold counts
    return max_window_entropy(m["places"], config.window) >= least - 1e-9


def with_secrets(frame: DataFrame, text: str, config: SecretConfig = SecretConfig()) -> DataFrame:
    """The frame with the columns ``base`` and ``spans`` (see ``find_secrets``) for a text that isn't null."""
    of = F.col(text)
    found = with_matches(
        frame,
        text,
        {
            "assign": (ASSIGN, of.rlike("(?i)password|passwd|secret|token|api_?key")),
            "access": (ACCESS, of.contains("AKIA")),
            "hex": (HEX, of.rlike("[0-9a-f]{16}")),
            "string": (_CANDIDATE, of.rlike("[0-9]")),
        },
    )
    rules = {"assign": lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= 12, "access": lambda m: F.length(m["text"]) >= 18}
    kept = found.select("*", *(F.filter(k, rules[k]).alias(f"{k}_kept") for k in rules)).withColumn("hex_kept", F.col("hex"))
    plain = lambda m: F.forall(F.split(m["text"], _SIGNS), lambda part: part.rlike(PLAIN_PART))
    allowed = lambda m: plain(m) | F.exists(F.array(*map(F.lit, ALLOWED)), lambda p: F.call_function("rlike", m["text"], p))
    free = kept.withColumn("string", F.filter(without_overlaps("string", *(f"{k}_kept" for k in KINDS)), lambda m: ~allowed(m)))
    placed = free.withColumn("string", F.transform("string", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), alphabet_places(m["text"]).alias("places"))))
    based = placed.withColumn("base", in_order(*(as_spans(F.col(f"{k}_kept"), k, i) for i, k in enumerate(KINDS))))
    judged = based.withColumn("string", F.filter("string", lambda m: _suspicious(m, config)))
    done = judged.withColumns({"base": fenced(F.col("base")), "spans": fenced(in_order(F.col("base"), as_spans(F.col("string"), ENTROPY, len(KINDS))))})
    return done.drop(*KINDS, *(f"{k}_kept" for k in KINDS), "string")


def find_secrets(documents: DataFrame, config: SecretConfig = SecretConfig()) -> DataFrame:
    """``documents(doc_id, text)`` to ``(doc_id, base, spans)``, a row each.

    ``base`` has the fixed kinds, ``spans`` also the entropy findings that
    overlap none of them: arrays of (start, rank, end, kind). A null or empty
    text has none. Repeated rows each get their row; other columns take no
    part; an empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return with_secrets(slim, "text", config).select("doc_id", "base", "spans")


def secret_report(documents: DataFrame, config: SecretConfig = SecretConfig()) -> DataFrame:
    """Counts of each fixed kind, the base spans' digest and all spans as text."""
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return find_secrets(documents, config).select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask_secrets(documents: DataFrame, config: SecretConfig = SecretConfig()) -> DataFrame:
    """The documents with each span replaced by ``[KIND]``; null texts stay null."""
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    found = with_secrets(documents.select(F.struct("*").alias("document"), text.alias("text")), "text", config)
    new = with_masked(found, "text", "spans", "new")
    changed = F.when(F.col("document.text").isNotNull(), F.col("new"))
    return new.select(*(changed.alias(c) if c == "text" else F.col(f"document.`{c}`").alias(c) for c in documents.columns))
