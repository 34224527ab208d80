"""Tokens, packing and token files against the tokenizers library's own ids."""

import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from pathloom.llm import fast_tokens, token_files
from pathloom.llm.arrowtext import column_bytes
from pathloom.llm.fast_tokens import FastEncoder
from pathloom.llm.packing import PackConfig, pack, plan_cuts
from pathloom.llm.scratch import new_folder
from pathloom.llm.token_files import TokenFileConfig, read_token_files, write_token_files

from .conftest import ODD_TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def test_fast_ids_are_the_librarys(library):
    letters = list("abs't rel\n  .1é'd ½ñ!漢\t\x1c")
    rng = np.random.default_rng(3)
    texts = ODD_TEXTS + ["<|endoftext|> inside", "'re''re x''s's 90's 'ſ", "\r\n\r\n x", "a\x85b\xa0c"]
    texts += ["".join(rng.choice(letters, 40)) for _ in range(2000)]
    found = FastEncoder(PATH)
    found.table.WORDS = 1 << 9  # forgets on the way
    data, rows = column_bytes(pa.array(texts))
    ids, counts = found.encode(data, rows)
    ends = np.append(0, np.cumsum(counts))
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() + [0] == ids_of(library, text), text


def test_equal_hashes_of_different_words(library, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["w" * (1 + i % 7) + "".join(rng.choice(list("abc"), 4)) for i in range(300)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(40)]
    monkeypatch.setattr(fast_tokens, "span_hashes", lambda codes, starts, ends: (ends - starts).astype(np.uint64) * np.uint64(2))
    found = FastEncoder(PATH)
    for a in range(0, 40, 8):
        data, rows = column_bytes(pa.array(texts[a : a + 8]))
        ids, counts = found.encode(data, rows)
        ends = np.append(0, np.cumsum(counts))
        for i, text in enumerate(texts[a : a + 8]):
            assert ids[ends[i] : ends[i + 1]].tolist() + [0] == ids_of(library, text), text


def test_parts_are_cut_by_bytes(spark):
    rows = [(i * i, "x" * (5000 if i < 30 else 20)) for i in range(400)] + [(100, "y" * 30_000), (None, "z")]
    sizes = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "length(text) + 1L bytes").repartition(4)
    config = TokenFileConfig(PATH, part_bytes=20_000)
    starts = token_files._starts(sizes, config)
    assert len(starts) >= 7 and starts == sorted(set(starts))
    parts = sizes.select("doc_id", "bytes", token_files._part_of(F.col("doc_id"), starts).alias("part")).collect()
    assert all(r["part"] == sum(s <= r["doc_id"] for s in starts) if r["doc_id"] is not None else r["part"] == 0 for r in parts)
    filled = Counter()
    for r in parts:
        filled[r["part"]] += r["bytes"] if r["doc_id"] != 100 else 0
    assert max(filled.values()) <= 30_000
    assert len(token_files._starts(sizes, replace(config, most_parts=3))) <= 3


def test_pieces_cover_each_id_once(spark, library, odd_documents, no_documents):
    pieces = pack(odd_documents.repartition(2), PackConfig(PATH, block=5000)).collect()
    by_sequence, by_doc = {}, {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], bytes(p["ids"])))
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.05 * sum(p["length"] for p in pieces)
    for row in odd_documents.distinct().collect():
        ids = ids_of(library, row["text"])
        parts = sorted(set(by_doc[row["doc_id"], len(ids)]))
        assert b"".join(b for _, b in parts) == np.array(ids, "<u4").tobytes()
    assert pack(no_documents, PackConfig(PATH)).count() == 0


def test_plan_is_the_best(spark):
    rng = np.random.default_rng(0)
    for length in (8, 16):
        for _ in range(50):
            places = np.unique(np.append(0, np.cumsum(rng.integers(1, length // 2, 12))))
            costs = rng.integers(0, 5, len(places))
            pad = lambda n: 0 if n & (n - 1) == 0 else length - n
            best = [0] + [None] * (len(places) - 1)
            for j in range(1, len(places)):
                best[j] = costs[j] + min(best[i] + pad(int(places[j] - places[i])) for i in range(j) if places[j] - places[i] <= length)
            chosen = plan_cuts(places, costs, length)
            cost = sum(costs[j] + pad(int(places[j] - places[i])) for i, j in zip(chosen, chosen[1:]))
            assert chosen[0] == 0 and chosen[-1] == len(places) - 1 and cost == best[-1]


def test_files_round_trip(spark, library, odd_documents, no_documents):
    folder = new_folder(spark, "test-tokens")
    manifest = write_token_files(odd_documents.repartition(3), folder, TokenFileConfig(PATH, part_bytes=20_000))
    got = read_token_files(manifest, folder).collect()
    rows = sorted(odd_documents.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want, start = [], 0
    for r in rows:
        ids = ids_of(library, r["text"])
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    folder = new_folder(spark, "test-tokens")
    assert read_token_files(write_token_files(no_documents, folder, TokenFileConfig(PATH)), folder).count() == 0
