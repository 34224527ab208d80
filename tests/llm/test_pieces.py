"""Suffix-array pieces against the sentencepiece library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pathloom.llm.arrowtext import column_bytes
from pathloom.llm.pieces import PieceEncoder, encode_pieces, suffix_array

from .conftest import ODD_TEXTS

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


def test_suffixes_are_in_order():
    codes = np.random.default_rng(0).integers(97, 100, 500).astype(np.uint32)
    order = suffix_array(codes, 16)
    keys = [codes[i : i + 16].tolist() for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(500))


def test_ids_are_the_librarys(library):
    rng = np.random.default_rng(4)
    texts = ODD_TEXTS + ["▁ ▁▁x", " " * 300 + "x", "\x00a\x00", "the" * 400]
    texts += ["".join(rng.choice(list("aeinrst  .1é'd漢"), 50)) for _ in range(500)]
    found = PieceEncoder(PATH)
    found.table.WORDS = 1 << 8  # forgets on the way
    data, rows = column_bytes(pa.array(texts))
    ids, counts = found.encode(data, rows)
    ends = np.append(0, np.cumsum(counts))
    for i, (text, back) in enumerate(zip(texts, found.decode(ids, counts))):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(text or ""), text
        assert back.decode() == (text or "").replace("▁", " ") == library.decode(ids[ends[i] : ends[i + 1]].tolist())


def test_odd_rows(spark, library, odd_documents, no_documents):
    got = sorted(encode_pieces(odd_documents, PATH).collect(), key=str)
    want = [(r["doc_id"], zlib.crc32(np.array(library.encode(r["text"] or ""), "<u4").tobytes())) for r in odd_documents.collect()]
    assert sorted((r["doc_id"], zlib.crc32(r["ids"])) for r in got if r["doc_id"] is not None) == sorted(w for w in want if w[0] is not None)
    assert len(got) == len(want) and encode_pieces(no_documents, PATH).count() == 0
