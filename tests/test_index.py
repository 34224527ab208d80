"""The whole way: triples and texts in, answers and their sources out."""

import json

import pytest

from pathloom.index import Index, best_entries

TEXTS = {
    "curie": "Marie Curie was born in Warsaw.\n\nShe married Pierre Curie in 1895.",
    "pierre": "Pierre Curie taught in Paris.",
}
FACTS = {
    "Marie Curie was born in Warsaw.": [("Marie Curie", "born in", "Warsaw", "was born in Warsaw")],
    "She married Pierre Curie": [("Marie Curie", "spouse", "Pierre Curie", "She married Pierre Curie")],
    "taught in Paris": [("Pierre Curie", "worked in", "Paris", "taught in Paris")],
}


def extract(chunks):
    """A scripted extractor: the facts whose key stands in a chunk."""
    rows = []
    for r in chunks.collect():
        facts = [f for key, own in FACTS.items() if key in r["text"] for f in own]
        names = sorted({n for s, _, t, _ in facts for n in (s, t)})
        reply = {"entities": [{"name": n, "type": "thing"} for n in names], "relations": [{"source": s, "type": p, "target": t, "evidence": e} for s, p, t, e in facts]}
        rows.append((r["chunk"], json.dumps(reply)))
    return chunks.sparkSession.createDataFrame(rows, "chunk string, reply string")


def documents(spark, texts):
    return spark.createDataFrame([(k, k, t) for k, t in texts.items()], "key string, title string, text string")


def test_ingest_walk_locate_read(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    states = {r["key"]: r["state"] for r in index.ingest(documents(spark, TEXTS), extract).collect()}
    assert states == {"curie": "new", "pierre": "new"}
    again = {r["key"]: r["state"] for r in index.ingest(documents(spark, TEXTS), extract).collect()}
    assert set(again.values()) == {"unchanged"}
    index = Index(spark, str(tmp_path / "i"))
    assert index.status().first()["n_documents"] == 2
    asked = spark.createDataFrame([("q", "Who is the spouse of Marie Curie?")], "q string, question string")
    best = best_entries(index.walk(asked)).first()
    assert best["confidence"] > 0
    spans = index.read(index.locate(asked, "graph"))
    assert any("married Pierre Curie" in r["passage"] for r in spans.collect())
    hybrid = index.locate(asked, "hybrid").collect()
    assert {r["key"] for r in hybrid} <= set(TEXTS) and len(hybrid) >= 2
    with pytest.raises(ValueError):
        index.locate(asked, "other")

    # one document goes: what it alone supported goes too
    states = {r["key"]: r["state"] for r in index.ingest(documents(spark, {"curie": TEXTS["curie"]}), extract).collect()}
    assert states == {"curie": "unchanged", "pierre": "removed"}
    types = {r["type"] for r in index.frames["edges"].collect()}
    assert types == {"born_in", "spouse"}


def test_import_and_neighbors(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("subject,relation,object,subject_name\na,r,b,Ann\nb,r,c,\n")
    index = Index(spark, str(tmp_path / "i"))
    assert tuple(index.import_triples(str(path)).first()) == (3, 2, 0)
    near = index.neighbors(spark.createDataFrame([("b",)], "node string")).orderBy("position").collect()
    assert [(r["dir"], r["other"]) for r in near] == [("out", "c"), ("in", "a")]
