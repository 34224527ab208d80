"""Regular-expression spans by columns of a frame: code points, end exclusive.

A text may have very many matches, so nothing here is done once per match over
the whole text: running values and cuts go by blocks of the square root of the
number of matches, and overlaps are found by halving. Each step is a column of
its own, so that it is computed once and lambdas stay shallow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One found span; rank orders the kinds of spans with one start.
SPAN = "struct<start:int,rank:int,end:int,kind:string>"
_FOUND = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
_NUMBERS = "array<bigint>"


def fenced(value: Column) -> Column:
    """The same value, but no filter moves below it.

    A filter that moves through the steps takes all their expressions along,
    each as often as it is named; plans of that size can't be handled.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _cut(items: str) -> Column:
    """An array in blocks of the square root of its length."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items)))).cast("int")
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(items) / size).cast("int") - 1))
    return F.transform(places, lambda b: F.slice(items, b * size + 1, size))


def running(frame: DataFrame, columns: dict[str, str], join: Callable[[Column, Column], Column]) -> DataFrame:
    """For each number of the arrays what ``join`` makes of 0 and those before it.

    ``columns`` has the arrays' names by those of the new columns.
    """
    zero = F.lit(0).cast("long")
    merge = lambda s, x: join(s, x).cast("long")

    def along(items: Column, start: Column) -> Column:
        append = lambda s, x: F.struct(merge(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(items, F.struct(start.alias("at"), F.array().cast(_NUMBERS).alias("out")), append, lambda s: s["out"])

    cut = frame.select("*", *(_cut(old).alias(f"{new}__cut") for new, old in columns.items()))
    whole = cut.select("*", *(F.transform(f"{new}__cut", lambda b: F.aggregate(b, zero, merge)).alias(f"{new}__whole") for new in columns))
    starts = whole.select("*", *(along(F.col(f"{new}__whole"), zero).alias(f"{new}__starts") for new in columns))
    inner = lambda new: F.transform(f"{new}__cut", lambda b, i: along(b, F.get(F.col(f"{new}__starts"), i)))
    done = starts.select("*", *(F.flatten(inner(new)).alias(new) for new in columns))
    return done.drop(*(f"{new}__{step}" for new in columns for step in ("cut", "whole", "starts")))


def with_matches(frame: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """A column for each pattern: all leftmost non-overlapping matches in ``text``, which isn't null.

    Splitting at the pattern gives the gaps, extraction the matches; running
    sums of their lengths are the positions. An entry has the texts to the
    match before and to the one after. Each pattern comes with a condition that
    spares texts without a match.
    """
    none = F.array().cast("array<string>")
    found = frame.select("*", *(F.when(when, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(none).alias(f"{k}__found") for k, (p, when) in patterns.items()))
    gaps = found.select("*", *(F.when(F.size(f"{k}__found") > 0, F.split(F.col(text), p, -1)).otherwise(none).alias(f"{k}__gaps") for k, (p, _) in patterns.items()))

    def lengths(k: str) -> Column:
        before = F.slice(f"{k}__gaps", F.lit(1), F.size(f"{k}__found"))
        return F.zip_with(f"{k}__found", before, lambda m, g: (F.length(m) + F.length(g)).cast("long"))

    def placed(k: str) -> Column:
        def one(m: Column, i: Column) -> Column:
            before = F.get(F.col(f"{k}__gaps"), i)
            start = F.get(F.col(f"{k}__sums"), i) + F.length(before)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"), before.alias("before"), F.coalesce(F.get(F.col(f"{k}__gaps"), i + 1), F.lit("")).alias("after"))

        return F.transform(f"{k}__found", one).cast(_FOUND)

    measured = gaps.select("*", *(lengths(k).alias(f"{k}__lengths") for k in patterns))
    summed = running(measured, {f"{k}__sums": f"{k}__lengths" for k in patterns}, lambda s, x: s + x)
    done = summed.select("*", *(placed(k).alias(k) for k in patterns))
    return done.drop(*(f"{k}__{step}" for k in patterns for step in ("found", "gaps", "lengths", "sums")))


def as_spans(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))).cast(f"array<{SPAN}>")


def in_order(*spans: Column) -> Column:
    """All spans by start, then by rank."""
    return F.array_sort(F.concat(*spans))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _smaller(items: str, field: str, than: Column, equal: bool) -> Column:
    """How many entries of an array with rising ``field`` have it smaller (or equal)."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        value = F.get(F.col(items), middle)[field]
        left = (value <= than) if equal else (value < than)
        going = state["low"] < state["high"]
        return F.struct(F.when(going & left, middle + 1).otherwise(state["low"]).alias("low"), F.when(going & ~left, middle).otherwise(state["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(items) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(items).alias("high")), halve, lambda s: s["low"])


def without_overlaps(found: str, *others: str) -> Column:
    """The entries of the column ``found`` that overlap none of the others'.

    Each other column has spans of one kind in order, none overlapping another.
    """

    def apart(m: Column) -> Column:
        clear = F.lit(True)
        for held in others:
            clear = clear & ((F.size(held) == 0) | (_smaller(held, "start", m["end"], False) <= _smaller(held, "end", m["start"], True)))
        return clear

    return F.filter(found, apart)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""

    def value(c: Column, i: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0))
        return F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, d: a + d) % 10 == 0


def with_masked(frame: DataFrame, text: str, spans: str, out: str) -> DataFrame:
    """The column ``out``: the text with each span (sorted; overlapping ones as one) replaced by ``[KIND]``."""
    ends = frame.select("*", F.transform(spans, lambda s: s["end"].cast("long")).alias("__ends"))
    reached = running(ends, {"__reached": "__ends"}, F.greatest)

    def part(s: Column, i: Column) -> Column:
        at = F.get(F.col("__reached"), i).cast("int")
        return F.struct(at.alias("at"), F.greatest(s["start"] - at, F.lit(0)).alias("gap"), F.when(s["start"] >= at, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("").alias("mark"))

    cut = reached.select("*", F.transform(spans, part).alias("__parts")).select("*", _cut("__parts").alias("__cut"))

    def piece(rows: Column) -> Column:
        first, last = F.get(rows, 0), F.element_at(rows, -1)
        return F.struct(rows.alias("rows"), first["at"].alias("at"), F.substring(F.col(text), first["at"] + 1, last["at"] + last["gap"] - first["at"]).alias("text"))

    # a block's gaps are cut from its own piece of the text
    pieces = cut.select("*", F.transform(F.filter("__cut", lambda b: F.size(b) > 0), piece).alias("__pieces"))
    written = lambda p: F.array_join(F.transform(p["rows"], lambda s: F.concat(F.substring(p["text"], s["at"] - p["at"] + 1, s["gap"]), s["mark"])), "")
    rest = F.substring(F.col(text), F.array_max("__ends").cast("int") + 1, F.length(text))
    new = F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform("__pieces", written), ""), rest)).otherwise(F.col(text))
    return pieces.select("*", fenced(new).alias(out)).drop("__ends", "__reached", "__parts", "__cut", "__pieces")
