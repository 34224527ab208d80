"""Byte-level BPE over whole Arrow columns: the tokenizers library, once per distinct word.

The pre-tokeniser splits a text into words that are encoded one by one, so the
ids of a text are those of its words in a row. Words are found by character
classes over the whole buffer; only words that a worker hasn't met go to the
library. Texts with characters outside the tabled scripts, or with a special
token's string, go to the library as they are.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable

import numpy as np

from .arrowtext import PIECE_BYTES, row_pieces, span_hashes

_TABLED = 0x590
_LETTER, _NUMBER, _SPACE, _OTHER, _UNSAFE = range(5)


def _character_classes() -> np.ndarray:
    table = np.full(_TABLED + 1, _UNSAFE, np.uint8)
    for c in [9, 10, 13, *range(32, 127), *range(0xA1, _TABLED)]:
        category = unicodedata.category(chr(c))
        if category[0] == "L":
            table[c] = _LETTER
        elif category[0] == "N":
            table[c] = _NUMBER
        elif c in (9, 10, 13, 32):
            table[c] = _SPACE
        elif category not in ("Cn", "Cc", "Cf"):
            table[c] = _OTHER
    return table


_CLASSES = _character_classes()


def _byte_signs() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for signs from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(others)}


_BYTE_SIGNS = _byte_signs()


class WordTable:
    """Ids of the words met so far, by the words' hashes, in open addressing.

    The words' characters are kept and compared, so that words whose hashes
    agree by chance don't get each other's ids.
    """

    #: Distinct words that a worker remembers; beyond, it starts afresh.
    WORDS = 1 << 19
    #: Characters that it keeps of them; words that are longer together start it afresh as well.
    SIGNS = 1 << 22

    def __init__(self) -> None:
        self.forget()

    def forget(self, coming: int = 0) -> None:
        size = 2 << (max(self.WORDS, coming) - 1).bit_length()
        self.keys = np.zeros(size, np.uint64)
        self.places = np.zeros(size, np.int32)
        self.known = 0
        self.ends = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.bounds = np.zeros(1 << 16, np.int64)
        self.signs = np.zeros(1 << 18, np.uint32)

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash its slot, or the free one where its probing ends."""
        mask = len(self.keys) - 1
        slots = (hashes & np.uint64(mask)).astype(np.int64)
        found = self.keys[slots]
        open_ = np.flatnonzero((found != hashes) & (found != 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & mask
            found[open_] = self.keys[slots[open_]]
            open_ = open_[(found[open_] != hashes[open_]) & (found[open_] != 0)]
        return slots, found == hashes

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        while len(array) < size:
            array = np.append(array, np.zeros_like(array))
        return array

    def _add(self, hashes: np.ndarray, counts: np.ndarray, flat: np.ndarray, signs: np.ndarray, sizes: np.ndarray) -> None:
        last, end = int(self.ends[self.known]), int(self.bounds[self.known])
        top = self.known + len(counts) + 1
        self.ends, self.bounds = self._room(self.ends, top), self._room(self.bounds, top)
        self.ids, self.signs = self._room(self.ids, last + len(flat)), self._room(self.signs, end + len(signs))
        self.ids[last : last + len(flat)] = flat
        self.signs[end : end + len(signs)] = signs
        self.ends[self.known + 1 : top] = last + np.cumsum(counts)
        self.bounds[self.known + 1 : top] = end + np.cumsum(sizes)
        numbers = np.arange(self.known, self.known + len(counts), dtype=np.int32)
        self.known += len(counts)
        while len(hashes):
            slots, _ = self._slots(hashes)
            _, first = np.unique(slots, return_index=True)
            self.keys[slots[first]] = hashes[first]
            self.places[slots[first]] = numbers[first]
            rest = np.ones(len(hashes), bool)
            rest[first] = False
            hashes, numbers = hashes[rest], numbers[rest]

    def look_up(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and where each word's begin.

        A word is the characters of ``codes`` from its start to its end.
        ``learn`` gets the indices of new words, one of each, and returns how
        many ids each has and all of them.
        """
        hashes = hashes | np.uint64(1)
        slots, hit = self._slots(hashes)
        if not hit.all():
            miss = np.flatnonzero(~hit)
            new, first = np.unique(hashes[miss], return_index=True)
            coming = int((ends - starts)[miss[first]].sum())
            if self.known + len(new) > self.WORDS or int(self.bounds[self.known]) + coming > self.SIGNS:
                new, first = np.unique(hashes, return_index=True)
                self.forget(len(new))
                miss = np.arange(len(hashes))
            fresh = miss[first]
            self._add(new, *learn(fresh), codes[_joined(starts[fresh], ends[fresh])], ends[fresh] - starts[fresh])
            slots, _ = self._slots(hashes)
        numbers = self.places[slots]
        low = self.ends[numbers]
        many = self.ends[numbers + 1] - low
        other = self._others(numbers, codes, starts, ends)
        if len(other):
            # the ids of another word with the same hash: these are encoded on their own, unremembered
            counts, flat = learn(other)
            base = len(self.ids)
            pool = np.append(self.ids, flat)
            low[other], many[other] = base + np.cumsum(counts) - counts, counts
        else:
            pool = self.ids
        return pool[_joined(low, low + many)], np.append(0, np.cumsum(many))

    def _others(self, numbers: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Indices of the words whose characters aren't those kept under their numbers."""
        low, sizes = self.bounds[numbers], ends - starts
        wrong = self.bounds[numbers + 1] - low != sizes
        same = np.flatnonzero(~wrong)
        differs = self.signs[_joined(low[same], low[same] + sizes[same])] != codes[_joined(starts[same], ends[same])]
        if differs.any():
            owner = np.repeat(same, sizes[same])
            wrong[owner[differs]] = True
        return np.flatnonzero(wrong)


def _joined(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places from each start to its end, one range after another."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class FastEncoder:
    """Ids of texts by one tokenizer file whose pre-tokeniser is the byte-level one."""

    def __init__(self, path: str) -> None:
        self.table = WordTable()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.by_words = bool(plain and not spec["normalizer"] and spec["model"]["type"] == "BPE" and not spec["post_processor"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.size = self.library.get_vocab_size()

    def encode(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of the UTF-8 buffer, and how many each row has."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, b in row_pieces(rows, PIECE_BYTES):
            own, many = self._piece(bytes(data[rows[a] : rows[b]]), rows[a : b + 1] - rows[a])
            ids.append(own)
            counts.append(many)
        return np.concatenate(ids), np.concatenate(counts)

    def _direct(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _piece(self, data: bytes, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(rows) - 1
        raw = np.frombuffer(data, np.uint8)
        points = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
        bounds = points[rows]
        text = data.decode("utf-8", "replace")
        unsafe = np.zeros(n, bool)
        if not self.by_words or len(text) != bounds[-1]:
            unsafe[:] = True
        else:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            classes = _CLASSES[np.minimum(codes, _TABLED)]
            odd = np.flatnonzero(classes == _UNSAFE)
            unsafe[np.searchsorted(bounds, odd, "right") - 1] = True
            for special in self.special:
                at = text.find(special)
                while at >= 0:
                    unsafe[np.searchsorted(bounds, at, "right") - 1] = True
                    at = text.find(special, at + 1)
        if unsafe.all():
            parts = [self._direct(data[rows[i] : rows[i + 1]].decode("utf-8", "replace")) for i in range(n)]
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)
        ids, counts = self._by_words(text, codes, classes, bounds)
        if unsafe.any():
            ends = np.append(0, np.cumsum(counts))
            parts = [self._direct(text[bounds[i] : bounds[i + 1]]) if unsafe[i] else ids[ends[i] : ends[i + 1]] for i in range(n)]
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts

    def _word_starts(self, codes: np.ndarray, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where words start: runs of one class, with one blank before; contractions apart."""
        n = len(codes)
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        start = first[:n].copy()
        start[1:] |= classes[1:] != classes[:-1]
        space = classes == _SPACE
        # the last white space before something else starts a word, and a blank joins what follows
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
        start[last] = True
        start[last[codes[last] == 32] + 1] = False
        quotes = np.flatnonzero((codes == 39) & start)
        for q in quotes.tolist():
            end = int(bounds[np.searchsorted(bounds, q, "right")])
            follow = bytes(codes[q + 1 : min(q + 3, end)].astype(np.uint8)) if (codes[q + 1 : min(q + 3, end)] < 128).all() else bytes(codes[q + 1 : q + 2].astype(np.uint8)) if q + 1 < end and codes[q + 1] < 128 else b""
            m = 2 if follow[:2] in (b"re", b"ve", b"ll") else 1 if follow[:1] in (b"s", b"t", b"m", b"d") else 0
            if m:
                start[q + 1 : q + 1 + m] = False
                if q + 1 + m < end:
                    start[q + 1 + m] = True
        return np.flatnonzero(start)

    def _by_words(self, text: str, codes: np.ndarray, classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self._word_starts(codes, classes, bounds)
        ends = np.append(starts[1:], len(codes))[: len(starts)]

        def learn(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            split = self.library.model.tokenize
            words = [text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            encoded = [[t.id for t in split(w.encode().decode("latin-1").translate(_BYTE_SIGNS))] for w in words]
            return np.array([len(e) for e in encoded], np.int64), np.array([i for e in encoded for i in e], np.uint32)

        ids, before = self.table.look_up(span_hashes(codes, starts, ends), codes, starts, ends, learn)
        return ids, np.diff(before[np.searchsorted(starts, bounds)])


_ENCODERS: dict[str, FastEncoder] = {}


def encoder(path: str) -> FastEncoder:
    """The worker's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = FastEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each row."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    closing = np.cumsum(counts + 1) - 1
    keep = np.ones(len(out), bool)
    keep[closing] = False
    out[keep] = ids
    return out, counts + 1
