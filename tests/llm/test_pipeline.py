"""The pipeline's stages against brute force on the smallest tables, and the queries' oracles."""

from __future__ import annotations

import hashlib
import struct
from pathlib import Path

import pytest

import corpus_pipeline
from sessionlens.llm import bpe, pii, quality_rules
from sessionlens.llm import queries as llm
from tests.llm.test_operators import brute_counts, expected_components, library
from tests.test_oracle import norm

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def test_stages_in_order(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    labels = spark.read.parquet(str(DATA / "labels.parquet"))
    steps = [f for _, f in corpus_pipeline.STAGES]
    assert len(steps) == 5
    one = corpus_pipeline.stored(steps[0](spark, docs, str(DATA)), "t0")
    rules = quality_rules.fit(docs, labels)
    kept = {r["row"]["doc_id"] for r in quality_rules.judged(docs, rules, keep=["doc_id"]).where("kept").collect()}
    assert {r["doc_id"] for r in one.collect()} == kept
    for r in docs.collect():
        n, _, _, _, rep = brute_counts(r["text"])
        if n < 10 or 100 * rep > 20 * n:
            assert r["doc_id"] not in kept
    two = corpus_pipeline.stored(steps[1](spark, one, str(DATA)), "t1")
    comp = expected_components([(r["doc_id"], r["text"]) for r in one.collect()])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({c for (i, _), c in comp.items() if i == c})
    three = corpus_pipeline.stored(steps[2](spark, two, str(DATA)), "t2")
    text = {r["doc_id"]: r["text"] for r in two.collect()}
    assert all(r["text"] == pii.redact(text[r["doc_id"]], pii.scan(text[r["doc_id"]])[1]) and r["n_chars"] == len(r["text"]) for r in three.collect())
    four = corpus_pipeline.stored(steps[3](spark, three, str(DATA)), "t3")
    size = sum(len(r["text"].encode().split()) for r in three.collect())
    mixed = sum(len(r["text"].encode().split()) for r in four.collect())
    assert abs(mixed - 1.5 * size) <= 20
    for d in (one, two, three, four):
        assert d.columns == docs.columns
    five = steps[4](spark, four, str(DATA)).collect()
    lib = library("byte_bpe_50k.json")
    want = []
    for r in four.collect():
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
    assert sorted(tuple(r)[:3] for r in five) == sorted(want)
    assert sorted(r[0] for r in corpus_pipeline.run(spark, str(DATA)).collect()) == sorted(r[0] for r in five)
    assert bpe.VOCABULARY == "byte_bpe_50k.json"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    got, want = norm(llm.queries()[name](spark, str(DATA)).toPandas()), norm(c.sql(llm.oracle_sql()[name]).df())
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_runs(spark, name):
    assert llm.queries()[name](spark, str(DATA)).count() > 0
