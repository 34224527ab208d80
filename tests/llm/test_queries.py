"""The registered queries over the smallest tables, against plain Python or SQL."""

import os
import re
import zlib

import numpy as np
import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")

from pathloom.llm import queries as Q
from pathloom.llm.line_quality import fit_line_model, line_quality

from .test_licenses import brute as license_words
from .test_line_quality import brute as measures
from .test_near_dup import brute as groups
from .test_spans import PII, SECRETS
from .test_spans import brute as spans
from .test_spans import valid


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    return dict(rows)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.tokenizer_path())


def ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name):
    frame = Q.queries()[name](spark, FOLDER)
    db = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = db.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(*columns).collect())) == sorted(result.fetchall())


@pytest.mark.parametrize("name, kinds", [("op2_bootstrapped_pii", PII), ("op8_entropy_secrets", SECRETS)])
def test_spans(spark, texts, name, kinds):
    got = {r["doc_id"]: r for r in Q.queries()[name](spark, FOLDER).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert set(spans(kinds, text)) <= set(got[i]["spans"].split(","))


def test_pieces(spark, texts):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_ids"], r["ids_crc32"], r["decoded_chars"]) for r in Q.op3_suffix_array_pieces(spark, FOLDER).collect()}
    for i, text in texts.items():
        own = np.array(model.encode(text or ""), "<u4")
        assert got[i] == (len(own), zlib.crc32(own.tobytes()), len(text or ""))


def test_packed_pieces(spark, texts, library):
    pieces, filled = {}, {}
    for r in Q.op4_dp_packing(spark, FOLDER).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        whole, at = ids(library, texts[i]), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole)
            assert r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= 1024


def test_token_files(spark, texts, library):
    start = 0
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.op7_token_files(spark, FOLDER).collect()}
    for i in sorted(texts):
        own = ids(library, texts[i])
        assert got[i] == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


def test_licenses_and_measures(spark, texts):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in Q.op6_diagonal_licenses(spark, FOLDER).collect()}
    assert got == {i: license_words(t) for i, t in texts.items()}
    rows = {r["doc_id"]: r for r in Q.op9_line_quality(spark, FOLDER).collect()}
    for i, text in texts.items():
        assert tuple(rows[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == measures(text)


def masked(text):
    found = sorted((m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(PII.items()) for m in re.finditer(p, text) if valid(kind, m))
    out, at = [], 0
    for start, _, end, kind in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline(spark, texts, library):
    import corpus_pipeline

    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = fit_line_model(documents, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = [r["doc_id"] for r in line_quality(documents, model).where("kept").collect()]
    assert 0.6 * len(texts) < len(good) < len(texts)
    kept = [i for i, (_, component) in groups([(i, texts[i]) for i in good], 5, 80).items() if i == component]
    out = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert set(out) == set(kept)
    for i, own in out.items():
        whole = ids(library, masked(texts[i]))
        for r in own:
            assert r["doc_tokens"] == len(whole) and r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())
    assert [name for name, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 4
