"""Quality rules by line labelling: a linear-chain CRF marks content or boilerplate.

Each line has a few features; Viterbi decoding labels the lines of a document
together, and the share of its words on content lines decides whether it stays.
The weights are fitted by conditional likelihood on a bounded sample of labelled
documents. Only documents have labels; those of the lines are latent: each round
labels the lines by the model so far, held to the documents' labels in so far as
most words of a good one are content and most of a poor one boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import WHITE, column_bytes, give_back, mix, row_pieces, span_hashes, tidy, window_hashes, word_spans
from .scratch import release, small_batches

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_NOISE = SYMBOLS.copy()
_NOISE[list(b"!=@^_~{}[]\\/+")] = True
_UPPER, _DIGIT, _LETTER, _CLOSE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CLOSE[list(b".!?:;\"')")] = True

FEATURES = ("bias", "noise", "upper", "digits", "stutter", "repeated", "seen", "length", "closed", "word_size", "lone")


@dataclass(frozen=True)
class LineModel:
    """Weights of the boilerplate label (content has none) and the chain's transitions.

    The defaults serve where no labelled documents of both kinds exist.
    """

    weights: tuple = (-2.0, 9.0, 2.5, 3.0, 6.0, 3.0, 1.0, 0.0, -0.5, 0.0, 5.0)
    start: tuple = (0.0, 0.0)
    moves: tuple = ((0.7, -0.7), (-0.7, 0.7))


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    #: A document fails if more than this percentage of its words repeat in windows.
    max_repeat_percent: int = 50
    window: int = 3
    #: Least share of words on content lines.
    min_content: float = 0.5
    #: At most so many labelled documents, of at most so many lines each, fit the model.
    fit_documents: int = 1000
    fit_lines: int = 400
    fit_steps: int = 150
    #: Rounds that label the lines anew, after one with the documents' labels.
    fit_rounds: int = 2
    ridge: float = 1e-5
    model: LineModel = field(default_factory=LineModel)


def _counts(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set from each bound to the next."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds])


def _measure(data: np.ndarray, rows: np.ndarray, window: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts for each row, the lines' features, their rows and their words."""
    n = len(rows) - 1
    starts, ends, owner = word_spans(data, rows)
    words = span_hashes(data, starts, ends)
    hashes, at = window_hashes(words, owner, window)
    keys = mix(hashes + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    repeats = np.zeros(len(words) + 1, np.int64)
    if len(twice):
        hit = at[np.isin(keys, twice)]
        np.add.at(repeats, hit, 1)
        np.add.at(repeats, hit + window, -1)
    repeats = np.cumsum(repeats)[:-1] > 0

    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate([rows[:-1], breaks + 1])
    line_row = np.concatenate([np.arange(n), np.searchsorted(rows, breaks, "right") - 1])
    order = np.lexsort((line_starts, line_row))
    line_starts, line_row = line_starts[order], line_row[order]
    last = np.append(line_row[1:] != line_row[:-1], True) if len(line_row) else np.zeros(0, bool)
    line_ends = np.append(line_starts[1:], len(data)) - 1
    line_ends[last] = rows[1:][line_row[last]]

    def per_line(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[line_ends] - sums[line_starts]

    first_word, end_word = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    line_words = end_word - first_word

    def per_word(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[end_word] - sums[first_word]

    line_keys = mix(span_hashes(data, line_starts, line_ends) + line_row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(line_keys, kind="stable")
    seen = np.zeros(len(line_keys), bool)
    seen[order[1:]] = line_keys[order][1:] == line_keys[order][:-1]
    seen &= line_words > 0

    solid = ~WHITE[data]
    points = solid & ((data & 0xC0) != 0x80)
    size = np.maximum(per_line(solid), 1)
    letters = np.maximum(per_line(_LETTER[data]), 1)
    some = np.maximum(line_words, 1)
    stutter = np.append(False, (words[1:] == words[:-1]) & (owner[1:] == owner[:-1]))[: len(words)]
    closing = np.zeros(len(line_words), bool)
    full = line_words > 0
    closing[full] = _CLOSE[data[ends[end_word[full] - 1] - 1]]
    features = np.stack(
        [
            np.ones(len(line_words)),
            per_line(_NOISE[data]) / size,
            per_line(_UPPER[data]) / letters,
            per_line(_DIGIT[data]) / size,
            per_word(stutter) / some,
            per_word(repeats) / some,
            seen,
            np.log1p(line_words) / 4,
            closing,
            np.minimum(size / some / 10, 3),
            per_word((ends - starts == 1) & _NOISE[data[starts]]) / some,
        ],
        axis=1,
    )
    word_bounds = np.searchsorted(owner, np.arange(n + 1))
    line_bounds = np.searchsorted(line_row, np.arange(n + 1))
    counts = {
        "n_words": np.diff(word_bounds),
        "word_chars": _counts(points, rows),
        "n_symbols": _counts(SYMBOLS[data], rows),
        "n_dup_lines": _counts(seen, line_bounds),
        "n_repeat_words": _counts(repeats, word_bounds),
    }
    return counts, features, line_row, line_words


def viterbi(scores: np.ndarray, bounds: np.ndarray, model: LineModel) -> np.ndarray:
    """Best label sequence of each chain: the scores' rows from one bound to the next."""
    start, moves = np.array(model.start), np.array(model.moves)
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    at, lengths = bounds[:-1][order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    # chains that still go on at each step are the first ones
    going = np.searchsorted(-lengths, -np.arange(longest), "left")
    back = np.zeros((len(scores), 2), np.int8)
    best = np.zeros((len(lengths), 2))
    for t in range(longest):
        m = going[t]
        own = scores[at[:m] + t]
        if t:
            options = best[:m, :, None] + moves
            back[at[:m] + t] = options.argmax(1)
            best[:m] = options.max(1) + own
        else:
            best[:m] = start + own
    labels = np.zeros(len(scores), np.int8)
    now = best.argmax(1).astype(np.int8) if len(best) else np.zeros(0, np.int8)
    for t in range(longest - 1, -1, -1):
        m = going[t]
        labels[at[:m] + t] = now[:m]
        now[:m] = back[at[:m] + t, now[:m]]
    return labels


def latent_labels(features: np.ndarray, words: np.ndarray, poor: int, model: LineModel, chained: bool, config: QualityConfig) -> np.ndarray:
    """Labels of a labelled document's lines: 1 is boilerplate.

    By the model, line by line or chained. Where they leave a poor document
    enough content, its likeliest lines turn to boilerplate until it has too
    little, and the other way round for a good one.
    """
    scores = features @ np.array(model.weights)
    if chained:
        labels = viterbi(np.stack([np.zeros_like(scores), scores], axis=1), np.array([0, len(scores)]), model).astype(np.int64)
    else:
        labels = (scores > 0).astype(np.int64)
    content, total = words[labels == 0].sum(), words.sum()
    for i in np.argsort(-scores if poor else scores, kind="stable"):
        if (content < config.min_content * total) == bool(poor):
            break
        if labels[i] != poor:
            labels[i] = poor
            content += -words[i] if poor else words[i]
    return labels


def fit_chain(features: list[np.ndarray], labels: list[np.ndarray], config: QualityConfig) -> LineModel:
    """Conditional maximum likelihood with a ridge, by Adam steps on all sequences at once."""
    order = sorted(range(len(features)), key=lambda i: -len(features[i]))
    lengths = np.array([len(features[i]) for i in order])
    longest, many = int(lengths[0]), len(order)
    x = np.zeros((many, longest, len(FEATURES)))
    gold = np.zeros((many, longest), np.int64)
    for row, i in enumerate(order):
        x[row, : lengths[row]] = features[i]
        gold[row, : lengths[row]] = labels[i]
    valid = np.arange(longest) < lengths[:, None]
    going = valid.sum(0)
    truth = np.eye(2)[gold[:, 0]]
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:, :-1][valid[:, 1:]], gold[:, 1:][valid[:, 1:]]), 1)
    theta = np.zeros(len(FEATURES) + 2 + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    total = valid.sum()
    for step in range(1, config.fit_steps + 1):
        weights, start, moves = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
        emit = np.zeros((many, longest, 2))
        emit[:, :, 1] = x @ weights
        alpha, beta = np.zeros((many, longest, 2)), np.zeros((many, longest, 2))
        alpha[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            m = going[t]
            alpha[:m, t] = np.logaddexp(alpha[:m, t - 1, :1] + moves[0], alpha[:m, t - 1, 1:] + moves[1]) + emit[:m, t]
        for t in range(longest - 2, -1, -1):
            m = going[t + 1]
            onward = beta[:m, t + 1] + emit[:m, t + 1]
            beta[:m, t] = np.logaddexp(moves[:, 0] + onward[:, :1], moves[:, 1] + onward[:, 1:])
        norm = np.logaddexp(alpha[:, 0, 0] + beta[:, 0, 0], alpha[:, 0, 1] + beta[:, 0, 1])
        odds = np.exp(alpha + beta - norm[:, None, None]) * valid[:, :, None]
        slope = np.zeros_like(theta)
        slope[:-6] = np.tensordot(gold * valid - odds[:, :, 1], x, 2)
        slope[-6:-4] = (truth - odds[:, 0]).sum(0)
        if longest > 1:
            pairs = alpha[:, :-1, :, None] + moves + (emit + beta)[:, 1:, None, :] - norm[:, None, None, None]
            expected = (np.exp(np.where(valid[:, 1:, None, None], pairs, -np.inf))).sum((0, 1))
            slope[-4:] = (seen - expected).ravel()
        slope = slope / total - config.ridge * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta + 0.25 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return LineModel(tuple(theta[:-6].tolist()), tuple(theta[-6:-4].tolist()), tuple(map(tuple, theta[-4:].reshape(2, 2).tolist())))


def fit_line_model(documents: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> LineModel:
    """Fit on at most ``fit_documents`` labelled documents, the first by a hash of their id.

    ``labels(doc_id, quality)``: 1 is good, 0 poor; rows with nulls don't count.
    Documents that fail the base rules teach nothing about lines, and of rows
    that repeat a doc_id one counts, the first by text. Without documents of
    both kinds the default model is returned.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = usable.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.fit_documents)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = column_bytes(batch.column("text"))
            for a, b in row_pieces(ends):
                counts, features, line_row, line_words = _measure(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], config.window)
                bounds = np.searchsorted(line_row, np.arange(b - a + 1))
                failed = _base_failed(counts, config)
                for i in np.flatnonzero(~failed & (np.diff(bounds) <= config.fit_lines)):
                    own = slice(bounds[i], bounds[i + 1])
                    yield pa.record_batch(
                        [batch.column("doc_id").slice(a + i, 1), batch.column("quality").slice(a + i, 1), pa.array([features[own].ravel().tolist()]), pa.array([line_words[own].tolist()])],
                        names=["doc_id", "quality", "features", "words"],
                    )

    once = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    small_batches(documents.sparkSession)
    rows = once.mapInArrow(tidy(lines), "doc_id long, quality int, features array<double>, words array<long>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    if len({r["quality"] for r in rows}) < 2:
        return LineModel()
    features = [np.array(r["features"]).reshape(-1, len(FEATURES)) for r in rows]
    poor = [1 - r["quality"] for r in rows]
    model = fit_chain(features, [np.full(len(f), p) for f, p in zip(features, poor)], config)
    for turn in range(config.fit_rounds):
        labels = [latent_labels(f, np.array(r["words"]), p, model, turn > 0, config) for f, r, p in zip(features, rows, poor)]
        model = fit_chain(features, labels, config)
    del rows, features, labels
    give_back()
    release(documents.sparkSession)
    return model


def _base_failed(found: dict[str, np.ndarray], config: QualityConfig) -> np.ndarray:
    return (found["n_words"] < config.min_words) | (100 * found["n_repeat_words"] > config.max_repeat_percent * found["n_words"])


def _judge(data: np.ndarray, rows: np.ndarray, config: QualityConfig, model: LineModel) -> dict[str, np.ndarray]:
    found, features, line_row, line_words = _measure(data, rows, config.window)
    bounds = np.searchsorted(line_row, np.arange(len(rows)))
    scores = np.zeros((len(features), 2))
    scores[:, 1] = features @ np.array(model.weights)
    content = viterbi(scores, bounds, model) == 0
    found["n_lines"] = np.diff(bounds)
    found["n_content_lines"] = _counts(content, bounds)
    words = np.zeros(len(content) + 1, np.int64)
    np.cumsum(np.where(content, line_words, 0), out=words[1:])
    found["content_share"] = np.diff(words[bounds]) / np.maximum(found["n_words"], 1)
    found["base_failed"] = _base_failed(found, config)
    found["kept"] = ~found["base_failed"] & (found["content_share"] >= config.min_content)
    return found


_COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "n_lines": "long", "n_content_lines": "long", "content_share": "double"}


def line_quality(documents: DataFrame, model: LineModel, config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row of measures and the verdict for each row of ``documents(doc_id, text)``.

    Words are runs without ASCII white space. A null or empty text has one
    empty line, no words, and fails. Ties of Viterbi scores go to content.
    Repeated rows each get their row; other columns take no part; an empty table
    gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = column_bytes(batch.column("text"))
            for a, b in row_pieces(ends):
                found = _judge(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], config, model)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), *(pa.array(found[c]) for c in _COLUMNS)], names=["doc_id", *_COLUMNS])

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(documents.sparkSession)
    return slim.mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{c} {t}" for c, t in _COLUMNS.items()))


def keep_quality(documents: DataFrame, model: LineModel, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows whose verdict is to keep them, all columns as they came."""
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = column_bytes(batch.column(place))
            kept = [_judge(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], config, model)["kept"] for a, b in row_pieces(ends)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    small_batches(documents.sparkSession)
    return documents.mapInArrow(tidy(run), documents.schema)
