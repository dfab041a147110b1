"""The public calls on a small store."""

from __future__ import annotations

import json

import pytest

from sessionlens.api import Engine
from sessionlens.operators.seams import HashedWords


@pytest.fixture(scope="module")
def engine(spark):
    texts = {"m1": "PDF rendering blocked by JavaScript", "m2": "entity extraction uses a small model", "m3": "old note on rendering"}
    emb = HashedWords().embed_batch(list(texts.values()))
    f = spark.createDataFrame
    store = {
        "memories": f([("m1", "ws", "fact", texts["m1"], None, 3, 0), ("m2", "ws", "insight", texts["m2"], "open", 1, 0), ("m3", "ws", "fact", texts["m3"], "superseded", 1, 0)], "id string, workspace_id string, memory_type string, content string, status string, evidence_count long, access_count long"),
        "memory_embeddings": f(list(zip(texts, emb, strict=True)), "id string, embedding array<double>"),
        "memory_sources": f([("m1", "s1"), ("m2", "s2"), ("m3", "s3")], "memory_id string, session_id string"),
        "session_graph_edges": f([("s1", "s2", 0.9), ("s1", "s3", 0.1)], "src string, tgt string, weight double"),
        "sessions": f([("s1",), ("s2",), ("s3",)], "id string"),
        "records": f([("r1", "s1", 0, texts["m1"]), ("r2", "s2", 0, texts["m2"])], "id string, session_id string, chunk_index long, chunk_text string"),
        "record_embeddings": f([("r1", emb[0]), ("r2", emb[1])], "id string, embedding array<double>"),
        "occurrences": f([("r1", "s1", "e1"), ("r2", "s2", "e1")], "record_id string, session_id string, entity_id string"),
        "entities": f([("e1", "model", "raw", 2)], "id string, canonical_name string, confidence string, degree_count long"),
    }
    return Engine(store)


def test_recall(engine):
    rows = engine.recall("pdf rendering").collect()
    assert rows[0]["id"] == "m1" and "m3" not in {r["id"] for r in rows}
    assert {r["id"] for r in engine.recall("pdf rendering", memory_type="insight").collect()} == {"m2"}
    scores = [r["score"] for r in engine.recall("pdf rendering", include_graph=True).collect()]
    assert scores == sorted(scores, reverse=True)


def test_chunks_and_tools(engine):
    assert engine.chunk_search("entity model", include_graph=True).first()["id"] == "r2"
    assert [r["memory_id"] for r in engine.graph_walk("m1").collect()] == ["m2"]
    assert json.loads(engine.tool("graph_walk", memory_id="m1")[0])["memory_id"] == "m2"
    assert engine.chunk_search("the of", method="lexical").count() == 0


def test_indexed_chunks(engine, tmp_path):
    indexed = Engine(engine.store)
    indexed.index_chunks(f"file://{tmp_path}/chunks")
    for q in ("entity model", "pdf rendering", "the of"):
        assert indexed.chunk_search(q).collect() == engine.chunk_search(q).collect()


def test_drop_session(engine):
    s = engine.dropped_session("s2")
    assert {r["id"] for r in s["memories"].collect()} == {"m1", "m3"}
    assert s["entities"].first()["degree_count"] == 1
    assert engine.stats().count() == len(engine.store)
