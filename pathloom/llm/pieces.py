"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that a worker hasn't met are put one after another and
indexed by a suffix array; every piece of the model is looked up in it by
binary search, which gives all its occurrences. These edges, sorted by position,
are relaxed: neighbouring symbols whose span is an edge are merged, the best
piece first, until no edge fits. What no piece covers falls back to bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import column_bytes, row_pieces, span_hashes
from .fast_tokens import WordTable

#: The sign that stands for a blank.
_BLANK = 0x2581
#: Characters that one suffix array indexes, unless one word has more.
_INDEXED = 1 << 18
#: Longer words are merged one at a time.
_LONG = 48


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` characters, by prefix doubling."""
    ranks = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    order = np.argsort(ranks, kind="stable")
    while width < depth:
        later = np.zeros(len(ranks), np.int64)
        later[:-width] = ranks[width:]
        keys = ranks * (len(ranks) + 2) + later
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        ranks = np.empty(len(keys), np.int64)
        ranks[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]))
        width *= 2
    return order


class PieceEncoder:
    """A BPE model of the sentencepiece library: its pieces, their scores and bytes."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        text = [model.id_to_piece(i) for i in range(size)]
        self.normal = np.array([i for i in range(size) if not special[i] and not model.is_byte(i)])
        self.byte_ids = np.zeros(256, np.uint32)
        raw = []
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(text[i][1:-1], 16)] = i
                raw.append(bytes([int(text[i][1:-1], 16)]))
            else:
                raw.append(b"" if special[i] else text[i].replace(chr(_BLANK), " ").encode())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_ends = np.append(0, np.cumsum([len(r) for r in raw]))
        self.width = max(len(text[i]) for i in self.normal)
        # ties of scores go to the piece further left, so equal scores share a rank
        scores = np.array([model.get_score(int(i)) for i in self.normal])
        self.ranks = np.unique(-scores, return_inverse=True)[1]
        words = [text[i].encode("utf-32-be") for i in self.normal]
        wide = 4 * self.width
        self.lengths = np.array([len(w) // 4 for w in words])
        self.low = np.array([w.ljust(wide, b"\x00") for w in words], f"S{wide}")
        self.high = np.array([w.ljust(wide, b"\xff") for w in words], f"S{wide}")
        inside = any(chr(_BLANK) in text[i].lstrip(chr(_BLANK)) for i in self.normal)
        if inside:
            raise ValueError("pieces that span words are not supported")
        self.table = WordTable()

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of pieces by position and length: key (position * (width + 1) + length), rank, id."""
        order = suffix_array(codes, self.width)
        padded = np.append(codes, np.zeros(self.width, codes.dtype)).astype(">u4")
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.width)[order]
        windows = np.ascontiguousarray(windows).view(f"S{4 * self.width}").ravel()
        low = np.searchsorted(windows, self.low, "left")
        high = np.searchsorted(windows, self.high, "right")
        many = high - low
        at = order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        which = np.repeat(np.arange(len(many)), many)
        keys = at * (self.width + 1) + self.lengths[which]
        by_place = np.argsort(keys)
        return keys[by_place], self.ranks[which][by_place], self.normal[which][by_place]

    def _relax(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words between the bounds, and how many each has."""
        keys, ranks, ids = self.edges(codes)
        never = np.int64(1) << 62

        def edge(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            """Index of the edge over each span, or that of none."""
            wanted = starts * (self.width + 1) + (ends - starts)
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1) if len(keys) else np.zeros(len(wanted), np.int64)
            good = (ends - starts <= self.width) & (keys[found] == wanted) if len(keys) else np.zeros(len(wanted), bool)
            return np.where(good, found, -1)

        word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        starts = np.flatnonzero(np.ones(len(codes), bool))
        alive = np.ones(len(codes) + 1, bool)
        lengths = np.diff(bounds)
        for w in np.flatnonzero(lengths > _LONG).tolist():
            self._merge_long(int(bounds[w]), int(bounds[w + 1]), keys, ranks, alive)
        starts = starts[np.isin(word, np.flatnonzero((lengths <= _LONG) & (lengths > 1)))]
        while len(starts):
            own = word[starts]
            ends = np.append(starts[1:], bounds[own[-1] + 1])
            ends = np.minimum(ends, bounds[own + 1])
            joins = np.append(own[1:] == own[:-1], False)
            spans = np.flatnonzero(joins)
            found = edge(starts[spans], ends[spans + 1])
            cost = np.full(len(starts), never)
            hit = found >= 0
            cost[spans[hit]] = ranks[found[hit]] * np.int64(len(codes) + 1) + starts[spans[hit]]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            best = np.minimum.reduceat(cost, first)
            live = best < never
            merged = np.flatnonzero(cost == np.repeat(best, np.diff(np.append(first, len(starts))))) if live.any() else np.zeros(0, np.int64)
            merged = merged[cost[merged] < never]
            alive[starts[merged + 1]] = False
            keep = np.repeat(live, np.diff(np.append(first, len(starts))))
            keep[merged + 1] = False
            starts = starts[keep]
        starts = np.flatnonzero(alive[:-1])
        ends = np.append(starts[1:], len(codes))
        found = edge(starts, ends)
        if (found >= 0).all():
            return ids[found].astype(np.uint32), np.diff(np.searchsorted(starts, bounds))
        parts, many = [], []
        for s, e, f in zip(starts.tolist(), ends.tolist(), found.tolist()):
            raw = self.byte_ids[np.frombuffer(codes[s:e].tobytes().decode("utf-32-le", "replace").encode(), np.uint8)] if f < 0 else ids[f : f + 1].astype(np.uint32)
            parts.append(raw)
            many.append(len(raw))
        totals = np.append(0, np.cumsum(many))
        return np.concatenate(parts), np.diff(totals[np.searchsorted(starts, bounds)])

    def _merge_long(self, low: int, high: int, keys: np.ndarray, ranks: np.ndarray, alive: np.ndarray) -> None:
        """The same for one word with a heap: linear but for a logarithm."""
        a, b = np.searchsorted(keys, (low * (self.width + 1), high * (self.width + 1)))
        known = dict(zip(keys[a:b].tolist(), ranks[a:b].tolist()))
        after = {s: s + 1 for s in range(low, high)}
        before = {s: s - 1 for s in range(low + 1, high)}
        heap: list = []

        def offer(left: int) -> None:
            right = after[left]
            if right < high:
                end = after[right]
                rank = known.get(left * (self.width + 1) + end - left) if end - left <= self.width else None
                if rank is not None:
                    heapq.heappush(heap, (rank, left, right, end))

        for s in range(low, high):
            offer(s)
        while heap:
            _, left, right, end = heapq.heappop(heap)
            if after.get(left) != right or after.get(right) != end:
                continue
            alive[right] = False
            del after[right]
            before.pop(right)
            after[left] = end
            if end < high:
                before[end] = left
            offer(left)
            if left > low:
                offer(before[left])

    def encode(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a UTF-8 buffer, and how many each row has."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, b in row_pieces(rows):
            texts = [bytes(data[s:e]).decode("utf-8", "replace") for s, e in zip(rows[a:b].tolist(), rows[a + 1 : b + 1].tolist())]
            own, many = self._texts(texts)
            ids.append(own)
            counts.append(many)
        return np.concatenate(ids), np.concatenate(counts)

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = [" " + t if t else t for t in texts]
        bounds = np.append(0, np.cumsum([len(t) for t in marked]))
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        codes[codes == 32] = _BLANK
        blank = codes == _BLANK
        start = np.zeros(len(codes) + 1, bool)
        start[1:-1] = blank[1:] & ~blank[:-1]
        start[bounds] = True
        starts = np.flatnonzero(start[:-1])
        ends = np.append(starts[1:], len(codes))[: len(starts)]

        def learn(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            many, flat = [], []
            for a, b in row_pieces(np.append(0, np.cumsum(ends[at] - starts[at])), _INDEXED):
                spans = [codes[s:e] for s, e in zip(starts[at[a:b]].tolist(), ends[at[a:b]].tolist())]
                got, sizes = self._relax(np.concatenate(spans), np.append(0, np.cumsum([len(s) for s in spans])))
                flat.append(got)
                many.append(sizes)
            return np.concatenate(many), np.concatenate(flat)

        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ids, before = self.table.look_up(span_hashes(codes, starts, ends), codes, starts, ends, learn)
        return ids, np.diff(before[np.searchsorted(starts, bounds)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each row's ids, without the blank that encoding puts first."""
        many = self.raw_ends[ids + 1] - self.raw_ends[ids]
        before = np.append(0, np.cumsum(many))
        raw = self.raw[np.repeat(self.raw_ends[ids] - before[:-1], many) + np.arange(before[-1])].tobytes()
        ends = before[np.append(0, np.cumsum(counts))].tolist()
        return [raw[s + (raw[s : s + 1] == b" ") : e] for s, e in zip(ends, ends[1:])]


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_pieces(documents: DataFrame, path: str) -> DataFrame:
    """``documents(doc_id, text)`` to ``(doc_id, ids, decoded)``, a row each.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the text read
    back from them. A null or empty text has no ids. Blanks and the model's sign
    for them are one. Repeated rows each get their row; other columns take no
    part; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = piece_encoder(path)
        for batch in batches:
            data, rows = column_bytes(batch.column("text"))
            for a, b in row_pieces(rows):
                ids, counts = found.encode(data[rows[a] : rows[b]], rows[a : b + 1] - rows[a])
                flat, ends = ids.astype("<u4").tobytes(), np.append(0, np.cumsum(4 * counts)).tolist()
                own = [flat[s:e] for s, e in zip(ends, ends[1:])]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(own, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in found.decode(ids, counts)], pa.string())], names=["doc_id", "ids", "decoded"])

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids binary, decoded string")


def piece_report(documents: DataFrame, path: str) -> DataFrame:
    """Number and checksum of each document's ids, and the decoded text's characters and digest."""
    done = encode_pieces(documents, path)
    return done.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))
