"""Deciders: who gives each option of a question its probability.

Options are rows ``(q, beam, ord, label, key, ...)``; order is part of their
meaning. A decider adds ``w``, a weight not below 0; ``normalized`` makes
probabilities of them. Models are plugged in as functions over pandas frames.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import first_by

STOP = "STOP"


class Decider(Protocol):
    def weigh(self, options: DataFrame) -> DataFrame:
        """The options with a column ``w``."""


@dataclass(frozen=True)
class TableDecider:
    """Weights from ``decisions(cur, opt, w)``; what isn't listed weighs nothing."""

    decisions: DataFrame

    def weigh(self, options: DataFrame) -> DataFrame:
        table = self.decisions.select(F.col("cur").alias("_cur"), F.col("opt").alias("_opt"), F.col("w").cast("double").alias("w"))
        return options.join(table, (F.col("cur") == F.col("_cur")) & (F.col("key") == F.col("_opt")), "left").drop("_cur", "_opt").fillna({"w": 0.0})


@dataclass(frozen=True)
class LexicalDecider:
    """One plus the number of words that an option shares with the question.

    A deterministic stand-in for a model.
    """

    stop_weight: float = 1.0

    def weigh(self, options: DataFrame) -> DataFrame:
        asked = words(F.col("question"))
        shared = F.size(F.array_intersect(asked, words(F.regexp_replace("key", "_", " "))))
        return options.withColumn("w", F.when(F.col("key") == STOP, F.lit(self.stop_weight)).otherwise(1.0 + shared))


@dataclass(frozen=True)
class FunctionDecider:
    """A function from a pandas frame of whole questions' options to their weights."""

    function: Callable[[pd.DataFrame], pd.Series]

    def weigh(self, options: DataFrame) -> DataFrame:
        function = self.function
        schema = T.StructType([*options.schema.fields, T.StructField("w", T.DoubleType())])
        return options.groupBy("q", "beam").applyInPandas(lambda pdf: pdf.sort_values("ord").assign(w=lambda d: function(d).astype(float)), schema)


def shuffled(options: DataFrame, seed: str) -> DataFrame:
    """Options in a seeded order of their own in each question."""
    by_hash = Window.partitionBy("q", "beam").orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "q", "beam", "key"), 256), "ord")
    return options.withColumn("ord", F.row_number().over(by_hash).cast("long"))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def normalized(weighed: DataFrame) -> DataFrame:
    """Probabilities ``p`` within each (q, beam); null where the weights have no mass."""
    own = Window.partitionBy("q", "beam")
    total = F.sum("w").over(own)
    valid = F.min(F.when(F.col("w").isNull() | F.isnan("w") | (F.col("w") < 0), 0).otherwise(1)).over(own)
    return weighed.withColumn("p", F.when((valid == 1) & (total > 0), F.col("w") / total)).drop("w")


def choice_confidence(n: Column, top: Column) -> Column:
    """How far the largest of n probabilities is from an even split: 0 to 1."""
    return F.when(n < 2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (n * top - 1) / (n - 1))))


def top_option(options: DataFrame) -> DataFrame:
    """The most probable option of each question, ties by the offered order."""
    order = [(-F.col("p")).alias("k"), F.col("ord")]
    return options.groupBy("q", "beam").agg(first_by(F.col("key"), *order).alias("key"), F.max("p").alias("p"), F.count("*").alias("n"))


def reshaped(options: DataFrame, temperature: float = 1.0, top_p: float = 1.0) -> DataFrame:
    """Temperature, then the smallest set of options with at least ``top_p`` of the mass, renormalised."""
    own = Window.partitionBy("q", "beam")
    ranked = own.orderBy(F.desc("r"), "ord")
    if temperature == 0:
        best = F.row_number().over(own.orderBy(F.desc("p"), "ord")) == 1
        return options.withColumn("r", F.when(best, 1.0).otherwise(0.0))
    out = options.withColumn("r", F.pow("p", 1.0 / temperature))
    out = out.withColumn("r", F.col("r") / F.sum("r").over(own))
    if top_p < 1:
        before = F.coalesce(F.sum("r").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        out = out.withColumn("r", F.when(before < top_p - 1e-12, F.col("r")).otherwise(0.0))
        out = out.withColumn("r", F.col("r") / F.sum("r").over(own))
    return out


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 that only depends on the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 13), 16, 10).cast("double") / float(16**13)


#: Width of the hashing embedder's vectors.
HASH_WIDTH = 256


def hash_vector(text: str | None) -> list[float]:
    """Signed counts of hashed words, scaled to length 1."""
    import re

    out = np.zeros(HASH_WIDTH, np.float32)
    for word in re.findall("[a-z0-9]+", (text or "").lower()):
        value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        out[(value >> 1) % HASH_WIDTH] += 1.0 if value & 1 else -1.0
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(hash_vector)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
