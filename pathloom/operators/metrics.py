"""Evaluation: answer scores, run summaries, calibration, selective prediction, cost.

Frames: ``answers(system, question_id, predicted array, gold array)`` and
``scores(system, question_id, type, f1, em, hits, status, cost, latency, calls,
confidence, no_decision)``. Everything is grouped; nothing is gathered in one
place but what a user function needs of one group.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_answer, tokens
from .graph import first_by
from .lineage import first_rows, numbered


def set_scores(answers: DataFrame) -> DataFrame:
    """Precision, recall, F1, exact match and hits@1 of answer sets in normal form."""
    norm = lambda c: F.array_distinct(F.transform(c, normalize_answer))
    rows = answers.select("system", "question_id", norm(F.col("predicted")).alias("p"), norm(F.col("gold")).alias("g"), F.transform("predicted", normalize_answer)[0].alias("first"))
    hit = F.size(F.array_intersect("p", "g"))
    precision = F.when(F.size("p") > 0, hit / F.size("p")).otherwise(0.0)
    recall = F.when(F.size("g") > 0, hit / F.size("g")).otherwise(0.0)
    f1 = F.when(hit > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    exact = ((F.size("p") == F.size("g")) & (hit == F.size("g"))).cast("double")
    return rows.select("system", "question_id", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), exact.alias("em"), F.coalesce(F.array_contains("g", F.col("first")), F.lit(False)).cast("double").alias("hits"))


def token_f1(pairs: DataFrame) -> DataFrame:
    """``pairs(id, predicted, gold)``: F1 over the multisets of tokens; 1 if both are empty."""
    words = lambda c: F.split(normalize_answer(F.col(c)), " ")
    long = lambda c, n: pairs.select("id", F.explode(F.filter(words(c), lambda w: w != "")).alias("word")).groupBy("id", "word").agg(F.count("*").alias(n))
    both = long("predicted", "np").join(long("gold", "ng"), ["id", "word"], "full")
    sums = both.groupBy("id").agg(F.sum(F.least(F.coalesce("np", F.lit(0)), F.coalesce("ng", F.lit(0)))).alias("common"), F.coalesce(F.sum("np"), F.lit(0)).alias("p"), F.coalesce(F.sum("ng"), F.lit(0)).alias("g"))
    f1 = F.when(F.col("common").isNull(), 1.0).when(F.col("common") == 0, 0.0).otherwise(2.0 * F.col("common") / (F.col("p") + F.col("g")))
    return pairs.select("id").join(sums, "id", "left").select("id", f1.alias("f1"))


def _at_place(values: DataFrame, keys: list[str], value: str, place: Column) -> DataFrame:
    """The value of each group at a place from 1 in ascending order; equal values are counted before."""
    levels = values.groupBy(*keys, value).agg(F.count("*").alias("times"))
    ranked = numbered(levels, keys, [value], ("times",)).withColumnRenamed("n", "_levels").withColumn("n", F.col("all_times"))
    found = (F.col("sum_times") >= place) & (F.col("sum_times") - F.col("times") < place)
    return ranked.where(found).select(*keys, F.col(value).alias("value"))


def nearest_rank(values: DataFrame, keys: list[str], value: str, percent: float) -> DataFrame:
    """The ``ceil(percent/100 * n)``-th smallest value of each group."""
    place = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100.0))
    return _at_place(values.where(F.col(value).isNotNull()), keys, value, place)


def nearest_ranks(values: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Several of them in one pass, each under its name."""
    levels = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("times"))
    ranked = numbered(levels, keys, [value], ("times",))

    def at(percent: float) -> Column:
        place = F.greatest(F.lit(1), F.ceil(F.col("all_times") * percent / 100.0))
        return F.max(F.when((F.col("sum_times") >= place) & (F.col("sum_times") - F.col("times") < place), F.col(value)))

    return ranked.groupBy(*keys).agg(*(at(p).alias(name) for name, p in percents.items()))


def index_percentile(values: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The value at index ``int(share * n)`` from 0: the scale report's definition."""
    return _at_place(values, keys, value, F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(float(share)))) + 1)


def absorbing_sum(cost: str) -> Column:
    """Unknown if any part is."""
    return F.when(F.count("*") == F.count(cost), F.sum(cost))


def run_totals(calls: DataFrame) -> DataFrame:
    """``calls(run, questions, tokens, cost)``: nothing spent if there was no call, unknown if none reported."""
    made = F.count("tokens")
    return calls.groupBy("run").agg(made.alias("calls"), F.coalesce(F.sum("questions"), F.lit(0)).alias("questions"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.when(made == 0, 0.0).otherwise(F.sum("cost")).alias("cost"))


def run_summary(scores: DataFrame) -> DataFrame:
    statuses = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "aborted", "error")]
    ranks = nearest_ranks(scores, ["system"], "latency", {"p50": 50, "p95": 95})
    means = scores.groupBy("system").agg(
        F.count("*").alias("n"),
        *(F.avg(c).alias(c) for c in ("f1", "em", "hits")),
        F.avg("latency").alias("mean_latency"),
        F.sum("cost").alias("cost"),
        F.avg("calls").alias("calls"),
        *statuses,
    )
    return means.join(ranks, "system", "left")


def by_type(scores: DataFrame) -> DataFrame:
    return scores.groupBy("system", "type").agg(F.count("*").alias("n"), F.avg("f1").alias("f1"), F.avg("em").alias("em"))


def _sure(scores: DataFrame) -> DataFrame:
    """Confidence with no answer as 0, and whether the answer is right."""
    return scores.select("system", "question_id", F.coalesce("confidence", F.lit(0.0)).alias("c"), (F.col("em") >= 0.5).cast("double").alias("y"))


def _bin(c: Column, bins: int) -> Column:
    """Which of the bins [i/n, (i+1)/n) has the confidence; 1 is in the last."""
    return F.aggregate(F.array(*(F.when(c >= F.lit(i / bins), 1).otherwise(0) for i in range(1, bins))), F.lit(0), lambda a, x: a + x)


def reliability_bins(scores: DataFrame, bins: int = 10) -> DataFrame:
    return _sure(scores).groupBy("system", _bin(F.col("c"), bins).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("c").alias("confidence"), F.avg("y").alias("accuracy"))


def ece(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    sums = _sure(scores).groupBy("system", _bin(F.col("c"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("y").alias("y"))
    return sums.groupBy("system").agg((F.sum(F.abs(F.col("c") - F.col("y"))) / F.sum("n")).alias("ece"))


def brier(scores: DataFrame) -> DataFrame:
    return _sure(scores).groupBy("system").agg(F.avg((F.col("c") - F.col("y")) * (F.col("c") - F.col("y"))).alias("brier"))


def auroc(scores: DataFrame) -> DataFrame:
    """Chance that a right answer is more confident than a wrong one, ties half; null with one class."""
    levels = _sure(scores).groupBy("system", "c").agg(F.sum("y").alias("right"), F.sum(1 - F.col("y")).alias("wrong"))
    # up to a level's own wrong answers, so half of them is taken back
    ranked = numbered(levels, ["system"], [F.col("c")], ("wrong",))
    pairs = ranked.withColumn("won", F.col("right") * (F.col("sum_wrong") - F.lit(0.5) * F.col("wrong")))
    total = F.sum("right") * F.sum("wrong")
    return pairs.groupBy("system").agg(F.when(total > 0, F.sum("won") / total).alias("auroc"))


def _most_confident_first(scores: DataFrame) -> DataFrame:
    rows = _sure(scores).withColumn("wrong", 1 - F.col("y"))
    return numbered(rows, ["system"], [F.desc("c"), F.col("question_id")], ("wrong", "y"))


def aurc(scores: DataFrame) -> DataFrame:
    """Area under the risk-coverage curve, its random and perfect references, accuracy at four coverages."""
    k = F.col("k")
    ideal = F.greatest(F.lit(0.0), k - F.col("all_y")) / k
    curve = _most_confident_first(scores).select("system", "y", "k", "n", (F.col("sum_wrong") / k).alias("risk"), ideal.alias("ideal"))
    at = [F.max(F.when(F.col("k") == F.greatest(F.lit(1), F.floor(F.col("n") * share)), 1 - F.col("risk"))).alias(f"acc_{int(100 * share)}") for share in (0.25, 0.5, 0.75, 1.0)]
    return curve.groupBy("system").agg(F.avg("risk").alias("aurc"), F.avg(1 - F.col("y")).alias("random"), F.avg("ideal").alias("perfect"), *at)


def selective_accuracy(scores: DataFrame) -> DataFrame:
    """Accuracy of the most confident half."""
    return _most_confident_first(scores).where("k <= n div 2").groupBy("system").agg(F.avg("y").alias("top_half"))


def calibration_row(scores: DataFrame) -> DataFrame:
    base = _sure(scores).groupBy("system").agg(F.count("*").alias("n"), F.avg("c").alias("confidence"), F.avg("y").alias("accuracy"))
    out = base
    for own in (ece(scores), brier(scores), auroc(scores), selective_accuracy(scores)):
        out = out.join(own, "system", "left")
    return out


def paired_difference(scores: DataFrame, one: str, other: str, value: str = "f1") -> DataFrame:
    """Differences on the questions that both systems have: ``(question_id, d)``."""
    a = scores.where(F.col("system") == one).select("question_id", F.col(value).alias("a"))
    b = scores.where(F.col("system") == other).select("question_id", F.col(value).alias("b"))
    return a.join(b, "question_id").select("question_id", (F.col("a") - F.col("b")).alias("d"))


def escalation(scores: DataFrame, primary: str, fallback: str, thresholds: tuple = (0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """What answering again below a confidence would give and cost."""
    a = scores.where(F.col("system") == primary).select("question_id", F.coalesce("confidence", F.lit(0.0)).alias("c"), F.col("f1").alias("f"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
    b = scores.where(F.col("system") == fallback).select("question_id", F.col("f1").alias("g"), F.coalesce("cost", F.lit(0.0)).alias("more"))
    rows = a.join(b, "question_id").withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    again = F.col("c") < F.col("threshold")
    return rows.groupBy("threshold").agg(F.count("*").alias("n"), F.avg(again.cast("double")).alias("escalated"), F.avg(F.when(again, F.col("g")).otherwise(F.col("f"))).alias("f1"), F.sum(F.col("cost") + F.when(again, F.col("more")).otherwise(0.0)).alias("cost"))


def break_even(costs: DataFrame) -> DataFrame:
    """``costs(a, b, fixed_a, each_a, fixed_b, each_b)``: from how many queries on a is no dearer than b; -1 for never."""
    more, saved = F.col("fixed_a") - F.col("fixed_b"), F.col("each_b") - F.col("each_a")
    return costs.select("a", "b", F.when((more <= 0) & (saved >= 0), 0).when(saved <= 0, -1).otherwise(F.greatest(F.lit(0), F.ceil(more / saved))).cast("long").alias("queries"))


def spearman(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``x`` and ``y`` by rank correlation, ties with the mean rank."""
    rows = pairs.select(*keys, "x", "y")
    for column in ("x", "y"):
        levels = rows.groupBy(*keys, column).agg(F.count("*").alias("times"))
        ranks = numbered(levels, keys, [column], ("times",))
        middle = F.col("sum_times") - (F.col("times") - 1) / F.lit(2.0)
        rows = rows.join(ranks.select(*keys, column, middle.alias(f"rank_{column}")), [*keys, column])
    return rows.groupBy(*keys).agg(F.corr("rank_x", "rank_y").alias("rho"))


def agreement(runs: DataFrame) -> DataFrame:
    """``runs(question_id, run, answers)``: the largest share of runs with one answer set."""
    sets = runs.groupBy("question_id", F.array_sort(F.array_distinct("answers")).alias("a")).agg(F.count("*").alias("n"))
    return sets.groupBy("question_id").agg((F.max("n") / F.sum("n")).alias("agreement"))


def seed_spread(scores: DataFrame, value: str = "f1") -> DataFrame:
    """Mean and sample deviation over the seeds' means."""
    means = scores.groupBy("system", "seed").agg(F.avg(value).alias("m"))
    return means.groupBy("system").agg(F.count("*").alias("seeds"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))


def rescored(scores: DataFrame, floor: float = 1e-3) -> DataFrame:
    """Walks that decided nothing get the floor as their confidence."""
    return scores.withColumn("confidence", F.when(F.col("no_decision"), F.lit(floor)).otherwise(F.col("confidence")))


def recall_at(rankings: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``rankings(method, question_id, rank, key)``, ``gold(question_id, key)``: recall and completeness in the first k distinct keys."""
    distinct = rankings.groupBy("method", "question_id", "key").agg(F.min("rank").alias("rank"))
    place = Window.partitionBy("method", "question_id").orderBy("rank", "key")
    top = distinct.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k)
    asked = rankings.select("method", "question_id").distinct()
    want = asked.join(gold.distinct(), "question_id")
    hit = want.join(top.select("method", "question_id", "key", F.lit(1.0).alias("hit")), ["method", "question_id", "key"], "left").fillna({"hit": 0.0})
    each = hit.groupBy("method", "question_id").agg(F.avg("hit").alias("recall"), F.min("hit").alias("complete"))
    return each.groupBy("method").agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("complete").alias("complete"))


def reciprocal_rank_fusion(rankings: DataFrame, constant: int = 60) -> DataFrame:
    """``rankings(question_id, method, rank, key)`` with ranks from 1: fused score and rank of each key."""
    best = rankings.groupBy("question_id", "method", "key").agg(F.min("rank").alias("rank"))
    fused = best.groupBy("question_id", "key").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    place = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 12)), "key")
    return fused.withColumn("rank", F.row_number().over(place).cast("int"))


def first_per_document(rankings: DataFrame) -> DataFrame:
    place = Window.partitionBy("question_id").orderBy("best", "key")
    best = rankings.groupBy("question_id", "key").agg(F.min("rank").alias("best"))
    return best.select("question_id", "key", F.row_number().over(place).cast("int").alias("rank"))


def bootstrap_mean(values: list[float], resamples: int = 2000, seed: int = 0, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean, by index picks with Python's generator."""
    if not len(values):
        return math.nan, math.nan
    rng = random.Random(seed)
    array, n = np.asarray(values, float), len(values)
    means = sorted(float(array[[rng.randrange(n) for _ in range(n)]].mean()) for _ in range(resamples))
    tail = (1 - level) / 2
    return means[int(tail * resamples)], means[min(resamples - 1, int((1 - tail) * resamples))]


def bootstrap_ci(values: DataFrame, keys: list[str], value: str, resamples: int = 2000, seed: int = 0, slice_size: int = 100) -> DataFrame:
    """Interval of each group's mean.

    Resampling n values with replacement gives each a Poisson-like number of
    picks; every row draws its own for all resamples, so groups of any size are
    summed where their rows lie. Equal values of a batch draw together, which
    has the same distribution, and only so many resamples are held at once.
    """
    def picks(parts):
        partition = TaskContext.get().partitionId()
        for batch, pdf in enumerate(parts):
            groups = [(key if isinstance(key, tuple) else (key,), *np.unique(own[value].to_numpy(float), return_counts=True)) for key, own in pdf.groupby(keys, dropna=False)]
            for low in range(0, resamples if groups else 0, slice_size):
                rng = np.random.default_rng([seed, partition, batch, low])
                out = []
                for key, x, times in groups:
                    n = rng.poisson(times[:, None], (len(x), min(slice_size, resamples - low)))
                    out.append((*key, low, (x @ n).tolist(), n.sum(0).astype(float).tolist()))
                yield pd.DataFrame(out, columns=[*keys, "low", "sums", "counts"])

    types = dict(values.dtypes)
    rows = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", low int, sums array<double>, counts array<double>"
    parts = rows.mapInPandas(picks, schema).select(*keys, "low", F.posexplode(F.arrays_zip("sums", "counts")).alias("i", "x"))
    means = parts.groupBy(*keys, (F.col("low") + F.col("i")).alias("i")).agg((F.sum("x.sums") / F.greatest(F.lit(1.0), F.sum("x.counts"))).alias("m"))
    return means.groupBy(*keys).agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))


def platt_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by damped Newton steps."""
    theta = np.array([1.0, 0.0])
    design = np.column_stack([x, np.ones_like(x)])

    def loss(t):
        z = design @ t
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge * t @ t / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (p - y) + ridge * theta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-6 and loss(theta - size * move) > loss(theta):
            size /= 2
        theta = theta - size * move
        if np.abs(move).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def platt_scaled(scores: DataFrame, fit_limit: int = 20_000, seed: int = 0, splits: int = 1) -> DataFrame:
    """Confidences recalibrated by the curve fitted on the other half of their system's questions.

    The curve is over the confidence's logarithm. Halves come from a hash of the
    question and the number of the split; at most ``fit_limit`` rows of each half
    (the first by hash) fit its curve, and every row is rescaled.
    """
    x = F.log(F.greatest(F.lit(1e-6), F.col("c")))
    rows = _sure(scores).select("system", "question_id", "c", "y", x.alias("x"), F.explode(F.sequence(F.lit(seed), F.lit(seed + splits - 1))).alias("split"))
    rows = rows.withColumn("half", F.pmod(F.xxhash64("question_id", "split"), F.lit(2)).cast("int"))
    sample = first_rows(rows, ["system", "split", "half"], [F.xxhash64("question_id"), F.col("question_id")], fit_limit)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("question_id")
        a, b = platt_fit(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        return pd.DataFrame({"system": [pdf["system"].iloc[0]], "split": [int(pdf["split"].iloc[0])], "half": [1 - int(pdf["half"].iloc[0])], "a": [a], "b": [b]})

    curves = sample.groupBy("system", "split", "half").applyInPandas(fit, "system string, split int, half int, a double, b double")
    scaled = (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("a") * F.col("x") + F.col("b"))))))
    return rows.join(curves, ["system", "split", "half"]).select("system", "question_id", "split", "half", F.col("c").alias("raw"), scaled.alias("confidence"), "y")


def platt_report(scores: DataFrame, splits: int = 10) -> DataFrame:
    """Mean calibration error and Brier score of held-out halves, over all splits both ways: ``(system, ece, brier)``."""
    held = platt_scaled(scores, splits=splits).withColumn("key", F.concat_ws("|", "system", "split", "half"))
    rows = held.select(F.col("key").alias("system"), "question_id", "confidence", F.col("y").alias("em"))
    each = ece(rows).join(brier(rows), "system")
    return each.groupBy(F.substring_index("system", "|", 1).alias("system")).agg(F.avg("ece").alias("ece"), F.avg("brier").alias("brier"))


def logistic_scores(rows: DataFrame, features: list[str], folds: int = 5, limit: int = 20_000) -> DataFrame:
    """``rows(id, y, features...)``: out-of-fold logistic scores; folds by a hash of the id.

    At most ``limit`` rows outside each fold fit its weights.
    """
    fold = F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int")
    own = rows.select("id", "y", *features, fold.alias("fold"))
    others = own.withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("target <> fold")
    sample = first_rows(others, ["target"], [F.xxhash64("id", F.lit(1)), F.col("id")], limit)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[features].to_numpy(float)
        mean, sd = x.mean(0), x.std(0)
        sd[sd == 0] = 1
        z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
        w, y = np.zeros(z.shape[1]), pdf["y"].to_numpy(float)
        for _ in range(300):
            w -= 0.5 * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) / len(y) + 1e-3 * w)
        return pd.DataFrame({"fold": [int(pdf["target"].iloc[0])], "w": [(w[:-1] / sd).tolist()], "b": [float(w[-1] - (w[:-1] * mean / sd).sum())]})

    weights = sample.groupBy("target").applyInPandas(fit, "fold int, w array<double>, b double")
    score = F.col("b")
    for i, name in enumerate(features):
        score = score + F.col("w")[i] * F.col(name)
    return own.join(weights, "fold").select("id", "y", (1 / (1 + F.exp(-score))).alias("score"))


def top_answer(options: DataFrame) -> DataFrame:
    return options.groupBy("question_id").agg(first_by(F.col("key"), (-F.col("score")).alias("k"), F.col("key")).alias("key"))


def idf(documents: DataFrame) -> DataFrame:
    """``ln(1 + N/df)`` of every word of ``documents(id, text)``."""
    n = documents.select(F.count("*").alias("n"))
    df = documents.select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("word", "df", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
