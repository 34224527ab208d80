"""Reports over runs: ingestion quality and counters, agents, loose accuracy, samples."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def entity_recall(gold: DataFrame, names: DataFrame) -> DataFrame:
    """``gold(question_id, name)`` against ``names(id, key)``: found, split over several nodes, over-merged names."""
    # the questions that ask for a name add nothing, so each name meets its nodes once
    hits = gold.select("name").distinct().join(names.select(F.col("key").alias("name"), "id").distinct(), "name", "left")
    per_name = hits.groupBy("name").agg(F.countDistinct("id").alias("nodes"))
    per_node = hits.where("id is not null").groupBy("id").agg(F.countDistinct("name").alias("names"))
    totals = per_name.agg(F.count("*").alias("gold"), F.count_if(F.col("nodes") > 0).alias("found"), F.count_if(F.col("nodes") > 1).alias("split"))
    return totals.crossJoin(per_node.agg(F.count_if(F.col("names") > 1).alias("over_merged"))).withColumn("recall", F.when(F.col("gold") > 0, F.col("found") / F.col("gold")))


def ingest_counters(events: DataFrame) -> DataFrame:
    """``events(document, kind)``: documents and how often each thing happened."""
    return events.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("document").alias("documents"))


def agent_table(turns: DataFrame) -> DataFrame:
    """``turns(arm, question_id, turns, tokens, cost, f1, grounded, tools array)``: means and tool calls per arm."""
    return turns.groupBy("arm").agg(
        F.count("*").alias("n"),
        *(F.avg(c).alias(c) for c in ("turns", "tokens", "cost", "f1")),
        F.avg(F.col("grounded").cast("double")).alias("grounded"),
        F.avg(F.size("tools").cast("double")).alias("tool_calls"),
    )


def groundedness(answers: DataFrame) -> DataFrame:
    """``answers(question_id, answer, output)``: the share of answers that stand in what the tools returned."""
    stands = F.contains(F.lower("output"), F.lower("answer")).cast("double")
    return answers.groupBy("question_id").agg(F.avg(stands).alias("grounded"))


def seeded_sample(rows: DataFrame, n: int, key: str, seed: int = 0, strata: list[str] | None = None) -> DataFrame:
    """n rows (of each stratum) by a hash of the key: the same ones wherever it runs."""
    order = [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    if not strata:
        return rows.orderBy(*order).limit(n)
    place = Window.partitionBy(*strata).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= n).drop("_n")


def loose(text: str) -> str:
    """Compatibility forms, lower case, numbers without separators, no punctuation."""
    flat = unicodedata.normalize("NFKC", text).lower()
    flat = re.sub(r"(?<=\d),(?=\d{3})", "", flat)
    return " ".join(re.sub(r"[^\w\s.]|(?<!\d)\.|\.(?!\d)", " ", flat).split())


@F.pandas_udf(T.DoubleType())
def loose_accuracy(answers: pd.Series, references: pd.Series) -> pd.Series:
    """The share of reference strings that an answer contains, both in loose form."""

    def one(answer: str | None, wanted) -> float:
        leaves = [loose(str(w)) for w in (wanted if wanted is not None else [])]
        text = f" {loose(answer or '')} "
        return sum(f" {w} " in text for w in leaves) / len(leaves) if leaves else 0.0

    return pd.Series([one(a, r) for a, r in zip(answers, references)], dtype=float)
