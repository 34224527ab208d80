"""Order-preserving packing: dynamic programming over cuts, with a monotone queue.

Documents are taken in the table's order as one stream of tokens. Cuts fall at
document or sentence ends (in long stretches without one, at even steps); the
plan with the least padding plus penalties for cut documents is found with a
queue of rising values, so each cut is looked at a constant number of times.
Each task packs its own part of the table in blocks: nothing is shuffled.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import column_bytes, row_pieces, tidy
from .fast_tokens import FastEncoder, encoder, with_end
from .scratch import small_batches


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str
    length: int = 1024
    end_id: int = 0
    #: What a cut inside a document costs, in tokens of padding: at a sentence's end, elsewhere.
    sentence_cost: int = 3
    hard_cost: int = 48
    #: Stretches without a sentence end may be cut at steps of this many tokens.
    step: int = 64
    #: Tokens of a block, one document at least; each block ends a sequence.
    block: int = 1 << 20


def sentence_ends(found: FastEncoder) -> np.ndarray:
    """Which ids end a sentence or a line, by their text."""
    out = np.zeros(found.size, bool)
    for token, i in found.library.get_vocab().items():
        bare = token.rstrip("\"')]")
        if i < found.size and (bare[-1:] in (".", "!", "?") or "Ċ" in token):
            out[i] = True
    return out


def _power_of_two(n: int) -> bool:
    return n & (n - 1) == 0


def plan_cuts(places: np.ndarray, costs: np.ndarray, length: int) -> np.ndarray:
    """The best increasing choice of ``places``, from the first to the last.

    Neighbouring choices are at most ``length`` apart, which the places allow.
    A window of n tokens is padded to the length, unless n is a power of two.
    ``costs`` has the penalty of a cut at each place.
    """
    n = len(places)
    at = places.tolist()
    costs = costs.tolist()
    # earlier places a power of two away, by place: those windows take no padding
    exact_from, exact_to = [], []
    power = 1
    while power <= length:
        low = np.searchsorted(places, places - power)
        good = np.flatnonzero((low < n) & (places[np.minimum(low, n - 1)] == places - power))
        exact_to.append(good)
        exact_from.append(low[good])
        power *= 2
    to, source = np.concatenate(exact_to), np.concatenate(exact_from)
    order = np.argsort(to, kind="stable")
    source = source[order].tolist()
    bounds = np.searchsorted(to[order], np.arange(n + 1)).tolist()
    best = [0] * n
    back = [0] * n
    queue: deque[int] = deque([0])
    lead = [0] * n  # best[i] + at[i], what the queue keeps rising
    for j in range(1, n):
        here = at[j]
        while here - at[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        value, origin = lead[i] + length - here, i
        for i in source[bounds[j] : bounds[j + 1]]:
            if best[i] < value:
                value, origin = best[i], i
        value += costs[j]
        best[j], back[j] = value, origin
        mine = lead[j] = value + here
        while queue and lead[queue[-1]] >= mine:
            queue.pop()
        queue.append(j)
    chosen, j = [n - 1], n - 1
    while j:
        j = back[j]
        chosen.append(j)
    return np.array(chosen[::-1])


def block_cuts(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray, config: PackConfig) -> np.ndarray:
    """Token positions of the cuts of one block, 0 and its length included."""
    total = len(ids)
    stops = np.flatnonzero(closes[ids]) + 1
    # a document's last sentence ends before its end id: the cut belongs after that
    stops = np.setdiff1d(stops, np.concatenate([doc_ends, doc_ends - 1]))
    tail = total - (1 << np.arange(int(config.length).bit_length()))
    soft = np.unique(np.concatenate([[0], doc_ends, stops]))
    gaps = np.diff(soft)
    wide = np.flatnonzero(gaps > config.step)
    many = (gaps[wide] - 1) // config.step
    inner = np.repeat(soft[wide], many) + config.step * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1)
    places = np.unique(np.concatenate([soft, inner, tail[tail > 0]]))
    costs = np.full(len(places), config.hard_cost)
    costs[np.searchsorted(places, stops)] = config.sentence_cost
    costs[np.searchsorted(places, doc_ends)] = 0
    costs[0] = 0
    return places[plan_cuts(places, costs, config.length)]


def _pieces(doc_ids: list, counts: np.ndarray, ids: np.ndarray, closes: np.ndarray, first_sequence: int, config: PackConfig) -> tuple[pa.RecordBatch, int]:
    doc_ends = np.cumsum(counts)
    cuts = block_cuts(ids, doc_ends, closes, config)
    starts = np.union1d(cuts[:-1], np.append(0, doc_ends[:-1]))
    ends = np.append(starts[1:], len(ids))
    window = np.searchsorted(cuts, starts, "right") - 1
    doc = np.searchsorted(doc_ends, starts, "right")
    flat = ids.astype("<u4").tobytes()
    batch = pa.record_batch(
        [
            pa.array([doc_ids[d] for d in doc], pa.int64()),
            pa.array(starts - (doc_ends[doc] - counts[doc])),
            pa.array(ends - starts),
            pa.array([flat[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())], pa.binary()),
            pa.array(counts[doc]),
            pa.array(first_sequence + window),
            pa.array(starts - cuts[window]),
        ],
        names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )
    return batch, first_sequence + len(cuts) - 1


def pack(documents: DataFrame, config: PackConfig) -> DataFrame:
    """``documents(doc_id, text)`` to pieces of sequences of at most ``length`` tokens.

    Per piece: doc_id, start (of its document's ids), length, ids (little-endian
    unsigned 32 bits), doc_tokens, sequence_id, offset (there, gapless from 0).
    A document has its text's ids and the end id; a null or empty text has the
    end id alone. Sequence numbers rise with the table's order and have gaps
    between tasks. Repeated rows are packed each; a null doc_id stays null;
    other columns take no part; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoder(config.tokenizer)
        closes = sentence_ends(found)
        sequence = TaskContext.get().partitionId() << 40
        doc_ids, counts, ids, held = [], [], [], 0
        for batch in batches:
            data, ends = column_bytes(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for a, b in row_pieces(ends):
                own, many = with_end(*found.encode(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]), config.end_id)
                doc_ids += names[a:b]
                counts.append(many)
                ids.append(own)
                held += len(own)
                if held >= config.block:
                    out, sequence = _pieces(doc_ids, np.concatenate(counts), np.concatenate(ids), closes, sequence, config)
                    yield out
                    doc_ids, counts, ids, held = [], [], [], 0
        if held:
            yield _pieces(doc_ids, np.concatenate(counts), np.concatenate(ids), closes, sequence, config)[0]

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(documents.sparkSession)
    return slim.mapInArrow(tidy(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
