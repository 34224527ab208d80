"""Scalar functions over strings: ids, hashes, keys, normal forms and renderings."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separator and prefixes of derived ids.
_UNIT = "\x1f"
TOKEN = r"[\p{L}\p{N}_]+"
#: Date forms that count as one value, day, month name and year in Spark's letters.
DATE_FORMS = ("d MMMM yyyy", "MMMM d, yyyy", "MMMM d yyyy", "yyyy-M-d", "d MMM yyyy", "MMM d, yyyy")
#: Letters that accents' removal leaves as they are.
LETTERS = {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"}


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def derived_id(prefix: str, length: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(_UNIT, *parts), 256), 1, length))


def edge_id(source: Column, relation: Column, target: Column) -> Column:
    """One id for each (source, relation, target)."""
    return derived_id("e:", 32, source, relation, target)


def literal_id(value: Column) -> Column:
    return derived_id("lit:", 24, value)


def entity_id(document: Column, key: Column, kind: Column) -> Column:
    return derived_id("n:", 24, document, key, kind)


def snake(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^0-9a-z]+", "_"), "^_+|_+$", "")


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def name_key_sql(text: Column) -> Column:
    """Case-insensitive key of ASCII names."""
    return stripped(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def name_key(names: pd.Series) -> pd.Series:
    """Case-folded names with single blanks; made once when names are loaded."""
    return names.map(lambda n: None if n is None else " ".join(n.casefold().split()))


def normalize_answer(text: Column) -> Column:
    """Answers compare without case, ASCII punctuation, articles and surplus blanks."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return stripped(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def local_name(iri: Column) -> Column:
    """What follows the last ``#`` or ``/``."""
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


def token_estimate(payload: Column) -> Column:
    return F.ceil(F.length(payload) / 3).cast("long")


def redact(text: Column, secret: str) -> Column:
    out = F.replace(text, F.lit(secret), F.lit("***"))
    return F.replace(out, F.lit(secret[-8:]), F.lit("***")) if len(secret) >= 8 else out


def snippet(text: Column, limit: int = 240) -> Column:
    flat = stripped(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def arrow(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" --"), relation, F.lit("--> "), target)


def name_set(names: Column, limit: int) -> Column:
    """``{a, b, +n more}``"""
    rest = F.size(names) - limit
    more = F.when(rest > 0, F.concat(F.lit(", +"), rest.cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.lit("{"), F.array_join(F.slice(names, 1, limit), ", "), more, F.lit("}"))


def card(name: Column, kind: Column, summary: Column) -> Column:
    return F.concat(name, F.lit(" ("), kind, F.lit(")"), F.when(F.length(summary) > 0, F.concat(F.lit(": "), summary)).otherwise(""))


def split_answers(text: Column) -> Column:
    """Answers between bars or line ends, without bullets, "unknown" and repeats."""
    parts = F.transform(F.split(text, r"[|\n]"), lambda p: stripped(F.regexp_replace(p, r"^\s*(?:[-*•]|[0-9]+[.)])\s*", "")))
    return F.array_distinct(F.filter(parts, lambda p: (p != "") & (F.lower(p) != "unknown")))


@F.pandas_udf(T.StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no blanks, so that equal values are equal text."""

    def one(v: str | None) -> str | None:
        if v is None:
            return None
        try:
            return json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return values.map(one)


def plain_name(name: str) -> str:
    """Letters and digits of a name, without accents and a trailing parenthesis."""
    bare = re.sub(r"\s*\([^)]*\)\s*$", "", name).translate(str.maketrans(LETTERS))
    flat = unicodedata.normalize("NFKD", bare).encode("ascii", "ignore").decode().lower()
    return " ".join(re.findall("[a-z0-9]+", flat))


@F.pandas_udf(T.StringType())
def norm_name(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else plain_name(n))


def norm_value(value: Column) -> Column:
    """A date in any of the known forms as ISO, else the plain name."""
    spoken = F.initcap(F.regexp_replace(F.trim(value), r"\s+", " "))
    dates = [F.date_format(F.try_to_timestamp(spoken, F.lit(form)), "yyyy-MM-dd") for form in DATE_FORMS]
    return F.coalesce(*dates, norm_name(value))


#: Cues that question features count.
CUES = {
    "superlative": r"\b(most|least|first|last|largest|smallest|highest|lowest|oldest|youngest)\b",
    "temporal": r"\b(when|year|before|after|during|since|until)\b",
    "conjunction": r"\b(and|both|or)\b",
    "counting": r"\b(how many|number of|count)\b",
}


def question_features(question: Column) -> list[Column]:
    text = F.lower(question)
    first = F.regexp_extract(text, r"\b(who|what|when|where|which|why|how)\b", 1)
    return [F.size(tokens(question)).cast("long").alias("n_words"), first.alias("wh_word"), *(text.rlike(p).cast("int").alias(c) for c, p in CUES.items())]
