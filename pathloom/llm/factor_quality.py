"""Quality scores of a factorisation machine.

A document's features are its hashed words and word shapes, structure
statistics of its lines and words, and metadata. Each feature has a weight and a
vector of a few factors; every pair of features interacts by the product of
their vectors. The sum over all pairs is half the square of the sum less the sum
of squares, factor by factor, so a score takes time linear in the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import LOWER, column_bytes, mix, row_pieces, span_hashes, word_spans
from .line_quality import FEATURES as LINE_FEATURES
from .line_quality import _measure


@dataclass(frozen=True)
class FactorConfig:
    #: Words and shapes are hashed to 2 to this power features.
    word_bits: int = 14
    factors: int = 8
    #: At most so many labelled documents fit the model, the first by a hash of their id.
    fit_documents: int = 3000
    #: Steps of fitting, each on a batch of documents; as many rounds over them as that takes.
    fit_steps: int = 400
    batch: int = 128
    rate: float = 0.05
    ridge: float = 1e-5
    seed: int = 7
    #: Scores from here on are predicted good.
    threshold: float = 0.3


#: Shares and means of a document, each from 0 to about 1.
STATISTICS = ("words", "word_size", "symbols", "repeats", "lines", "line_size", *(f"mean_{f}" for f in LINE_FEATURES[1:]), "noisy_lines", "upper_lines", "stuttering_lines", "closing_lines")
METADATA = ("n_chars", "n_chars_missing", "n_chars_differs")
_DENSE = len(STATISTICS) + len(METADATA) + 1  # and whether there are no words

_UPPER, _DIGIT, _OTHER = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_OTHER[33:48] = _OTHER[58:65] = _OTHER[91:97] = _OTHER[123:127] = True


@dataclass(frozen=True)
class FactorModel:
    """``bias``, a weight for each feature and its factors; the config that the features were made by."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    config: FactorConfig

    def score(self, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(raw_scores(self.bias, self.weights, self.factors, bounds, index, value)[0], -40, 40)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows from each bound to the next; every document has some."""
    return np.add.reduceat(values, bounds[:-1], axis=0) if len(bounds) > 1 else values[:0]


def raw_scores(bias: float, weights: np.ndarray, factors: np.ndarray, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of documents, whose features lie between the bounds, and the sums by factor."""
    weighted = factors[index] * value[:, None]
    total = _sums(weighted, bounds)
    pairs = 0.5 * (total**2 - _sums(weighted**2, bounds)).sum(1)
    return bias + _sums(weights[index] * value, bounds) + pairs, total


def gradient(bias: float, weights: np.ndarray, factors: np.ndarray, bounds: np.ndarray, index: np.ndarray, value: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the mean logistic loss."""
    raw, total = raw_scores(bias, weights, factors, bounds, index, value)
    slope = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels) / len(labels)
    each = np.repeat(slope, np.diff(bounds)) * value
    by_weight, by_factor = np.zeros_like(weights), np.zeros_like(factors)
    np.add.at(by_weight, index, each)
    np.add.at(by_factor, index, each[:, None] * (np.repeat(total, np.diff(bounds), axis=0) - factors[index] * value[:, None]))
    return float(slope.sum()), by_weight, by_factor


def _word_features(data: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and values of the hashed words and shapes; the squares of each kind sum to 1 in a row."""
    starts, ends, owner = word_spans(data, rows)

    def per_word(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[ends] - sums[starts]

    size, upper, digit, other = ends - starts, per_word(_UPPER[data]), per_word(_DIGIT[data]), per_word(_OTHER[data])
    closes = np.where(_OTHER[data[ends - 1]], data[ends - 1], 0) if len(ends) else size
    level = lambda n: np.minimum(n, 2) + (n == size)
    shapes = ((((level(upper) * 4 + level(digit)) * 4 + level(other)) * 8 + np.minimum(size // 3, 7)) * 256 + closes).astype(np.uint64)
    found = []
    for salt, keys in ((1, span_hashes(LOWER[data], starts, ends)), (2, shapes)):
        bucket = (mix(keys + np.uint64(salt << 56)) >> np.uint64(64 - bits)).astype(np.int64)
        pairs, counts = np.unique(owner << bits | bucket, return_counts=True)
        row = pairs >> bits
        found.append((row, pairs & ((1 << bits) - 1), np.sqrt(counts / np.maximum(np.bincount(row, counts, len(rows) - 1)[row], 1))))
    return tuple(np.concatenate(x) for x in zip(*found))


def features(data: np.ndarray, rows: np.ndarray, n_chars: np.ndarray, config: FactorConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, indices and values of the features of documents; ``n_chars`` is NaN where it is missing."""
    n = len(rows) - 1
    counts, lines, line_row, line_words = _measure(data, rows, 3)
    words = counts["n_words"]
    some, many = np.maximum(words, 1), np.maximum(np.bincount(line_row, minlength=n), 1)
    by_line = lambda x, weight, whole: np.bincount(line_row, x * weight, n) / whole
    full = line_words > 0
    filled = np.maximum(np.bincount(line_row, full, n), 1)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = np.diff(points[rows])
    named = {f: i for i, f in enumerate(LINE_FEATURES)}
    statistics = [
        np.log1p(words) / 10,
        np.minimum(counts["word_chars"] / some / 10, 3),
        np.minimum(counts["n_symbols"] / np.maximum(counts["word_chars"], 1), 1),
        counts["n_repeat_words"] / some,
        np.log1p(many) / 8,
        np.log1p(words / many) / 6,
        *(by_line(lines[:, i], line_words, some) for i in range(1, len(LINE_FEATURES))),
        by_line(lines[:, named["noise"]] > 0.15, full, filled),
        by_line(lines[:, named["upper"]] > 0.6, full, filled),
        by_line(lines[:, named["stutter"]] > 0.3, full, filled),
        by_line(lines[:, named["closed"]], full, filled),
    ]
    missing = np.isnan(n_chars)
    metadata = [np.where(missing, 0, np.log1p(np.abs(np.nan_to_num(n_chars)))) / 12, missing, ~missing & (n_chars != chars)]
    dense = np.stack([*statistics, *metadata, words == 0], axis=1).astype(float)
    at, which = np.nonzero(dense)
    row, bucket, value = _word_features(data, rows, config.word_bits)
    owner = np.concatenate([at, row])
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    index = np.concatenate([which, bucket + _DENSE])[order]
    return np.searchsorted(owner, np.arange(n + 1)), index, np.concatenate([dense[at, which], value])[order]


def _batch_features(batch: pa.RecordBatch, config: FactorConfig) -> Iterator[tuple[int, int, tuple]]:
    data, ends = column_bytes(batch.column("text"))
    n_chars = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(float)
    for a, b in row_pieces(ends):
        yield a, b, features(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], n_chars[a:b], config)


def _slim(documents: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("double") if "n_chars" in documents.columns else F.lit(None).cast("double")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


def fit(bounds: np.ndarray, index: np.ndarray, value: np.ndarray, labels: np.ndarray, config: FactorConfig) -> FactorModel:
    """Adagrad steps on batches of documents in a fixed random order."""
    rng = np.random.default_rng(config.seed)
    size = _DENSE + (1 << config.word_bits)
    share = np.clip(labels.mean(), 0.01, 0.99)
    bias, weights, factors = float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, config.factors))
    seen_bias, seen_weights, seen_factors = 1e-6, np.full(size, 1e-6), np.full(factors.shape, 1e-6)
    for _ in range(-(-config.fit_steps * config.batch // len(labels))):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), config.batch):
            chosen = order[at : at + config.batch]
            lengths = np.diff(bounds)[chosen]
            own = np.append(0, np.cumsum(lengths))
            place = np.repeat(bounds[:-1][chosen] - own[:-1], lengths) + np.arange(own[-1])
            by_bias, by_weight, by_factor = gradient(bias, weights, factors, own, index[place], value[place], labels[chosen])
            by_weight += config.ridge * weights
            by_factor += config.ridge * factors
            seen_bias += by_bias**2
            seen_weights += by_weight**2
            seen_factors += by_factor**2
            bias -= config.rate * by_bias / seen_bias**0.5
            weights -= config.rate * by_weight / np.sqrt(seen_weights)
            factors -= config.rate * by_factor / np.sqrt(seen_factors)
    return FactorModel(bias, weights, factors, config)


def fit_factor_model(documents: DataFrame, labels: DataFrame, config: FactorConfig = FactorConfig()) -> FactorModel:
    """Fit on at most ``fit_documents`` labelled documents.

    ``labels(doc_id, quality)``: 1 is good, 0 poor; rows with nulls don't count,
    nor do ids whose CRC-32 is divisible by 5, which are held out. Of rows that
    repeat a doc_id one counts, the first by text. Without documents of both
    kinds every score is a half.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out("doc_id"))
    sample = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.fit_documents)
    once = _slim(documents).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("x")).select("doc_id", "quality", "x.text", "x.n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, (bounds, index, value) in _batch_features(batch, config):
                cut = bounds.astype(np.int32)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), batch.column("quality").slice(a, b - a), pa.ListArray.from_arrays(cut, index.astype(np.int32)), pa.ListArray.from_arrays(cut, value.astype(np.float32))], names=["doc_id", "quality", "index", "value"])

    rows = once.mapInArrow(run, "doc_id long, quality int, index array<int>, value array<float>").toArrow().sort_by("doc_id")
    labels_found = rows.column("quality").to_numpy()
    if len(set(labels_found.tolist())) < 2:
        size = _DENSE + (1 << config.word_bits)
        return FactorModel(0.0, np.zeros(size), np.zeros((size, config.factors)), config)
    index, value = rows.column("index").combine_chunks(), rows.column("value").combine_chunks()
    bounds = np.append(0, np.cumsum(index.value_lengths().to_numpy()))
    return fit(bounds, index.flatten().to_numpy(), value.flatten().to_numpy().astype(float), labels_found.astype(float), config)


def held_out(column: str):
    """Whether the CRC-32 of the decimal id is divisible by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score_quality(documents: DataFrame, model: FactorModel) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``documents(doc_id, text, n_chars)``.

    Words are runs without ASCII white space. Null and empty texts are scored by
    what is left: they have no words. ``n_chars`` may be null or missing; no
    other column takes part. Repeated rows each get their row; an empty table
    gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, found in _batch_features(batch, model.config):
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(model.score(*found))], names=["doc_id", "score"])

    scored = _slim(documents).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= model.config.threshold, 1).otherwise(0).alias("predicted"))
