"""The stored cells against all distances, on clustered vectors and odd rows."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.api import Engine
from sessionlens.operators import retrieval as R
from sessionlens.operators import vector_index as X
from sessionlens.operators.seams import HashedWords

ROWS = "id long, v array<float>, kind int"


def clustered(rng, n, groups=60, size=24):
    at = rng.normal(size=(groups, size)) * 4
    return [(i, [float(x) for x in at[i % groups] + rng.normal(size=size) * 0.3], i % 3) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    made = clustered(rng, 6000)
    nan = float("nan")
    made += [(6000 + k, v, 1) for k, v in enumerate([None, [], [None] * 24, [nan] * 24, [float("inf")] * 24, [0.0] * 24])]
    made += [(7000 + k, made[17][1], 1) for k in range(40)]  # ties
    return spark.createDataFrame(made, ROWS)


def scanned(rows, query, k, metric):
    good = rows.where(X.usable(F.col("v")))
    if metric == "cosine":
        good = good.where("id <> 6005")
    return [tuple(r) for r in R.knn(good, "id", "v", query, k, metric).collect()]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_exact_and_few_cells(spark, rows, tmp_path, metric):
    folder = f"file://{tmp_path}/index"
    X.written(rows, "id", "v", folder, metric, keep=["kind"])
    index = X.Index(spark, folder)
    n, shares = sum(b[2] for b in index.bounds.values()), []
    assert n == 6000 + 40 + (metric == "l2")
    rng = np.random.default_rng(9)
    queries = [r.v for r in rows.where("id in (5, 17, 2000)").orderBy("id").collect()] + [rng.normal(size=24).tolist()]
    for q in queries:
        q = [float(x) for x in q]
        found = index.knn(q, 15)
        got, want = [tuple(r) for r in found.collect()], scanned(rows, q, 15, metric)
        # equal vectors are told apart by key only where their distances are computed alike
        assert [d for _, d in got] == pytest.approx([d for _, d in want], abs=1e-9)
        if metric == "l2":
            assert got == want
        shares.append(index.read / n)
    assert max(shares[:3]) < 0.2
    kept = index.knn([float(x) for x in queries[0]], 15, F.col("kind") == 2)
    assert [d for _, d in map(tuple, kept.collect())] == pytest.approx([d for _, d in scanned(rows.where("kind = 2"), [float(x) for x in queries[0]], 15, metric)], abs=1e-9)
    plan = kept._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*cell", plan)


def test_steps_close_the_search(spark, rows, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/index"
    X.written(rows, "id", "v", folder, cells=200)
    monkeypatch.setattr(X, "FIRST_ROWS", 1)
    monkeypatch.setattr(X, "STEP_ROWS", 50)
    q = [0.5] * 24
    assert [tuple(r) for r in X.Index(spark, folder).knn(q, 30).collect()] == scanned(rows, q, 30, "l2")


def test_added_rows_are_found(spark, rows, tmp_path):
    folder = f"file://{tmp_path}/index"
    X.written(rows, "id", "v", folder)
    far = spark.createDataFrame([(9000, [40.0] * 24, 0), (9001, rows.where("id = 3").first().v, 0), (9002, None, 0)], ROWS)
    X.added(far, "v", folder)
    index = X.Index(spark, folder)
    assert index.knn([39.0] * 24, 1).first().id == 9000
    assert [r.id for r in index.knn([float(x) for x in rows.where("id = 3").first().v], 2).collect()] == [3, 9001]


def test_odd_indexes(spark, rows, tmp_path):
    X.written(rows.limit(0), "id", "v", f"file://{tmp_path}/none")
    assert X.Index(spark, f"file://{tmp_path}/none").knn([1.0] * 24, 3).count() == 0
    X.written(rows.where("id = 4"), "id", "v", f"file://{tmp_path}/one", "cosine")
    one = X.Index(spark, f"file://{tmp_path}/one")
    assert one.knn([1.0] * 24, 3).count() == 1
    assert one.knn([0.0] * 24, 3).count() == 0
    assert one.knn([], 3).count() == 0


def test_engine_finds_chunks_added_after_indexing(spark, tmp_path):
    embed = HashedWords().embed_batch

    def store(texts):
        vectors = embed(texts)
        return {
            "records": spark.createDataFrame([(f"r{k}", f"s{k % 2}", 0, t) for k, t in enumerate(texts)], "id string, session_id string, chunk_index long, chunk_text string"),
            "record_embeddings": spark.createDataFrame([(f"r{k}", v) for k, v in enumerate(vectors)], "id string, embedding array<double>"),
        }

    texts = ["parser fails on nested quotes", "cache grows without bound", "index rebuild is slow", "quotes in the parser again"]
    folder = f"file://{tmp_path}/chunks"
    engine = Engine(store(texts[:3]))
    engine.index_chunks(folder)
    later = Engine(store(texts), chunk_index=folder)
    plain = Engine(store(texts))
    for _ in range(2):  # before its chunks are indexed the engine scans, after it reads the index
        for session in (None, "s1"):
            assert later.chunk_search("parser quotes", session=session).collect() == plain.chunk_search("parser quotes", session=session).collect()
        later.index_chunks(folder)
        assert later._indexed()


def test_a_sample_is_cut_before_it_is_ordered(spark, monkeypatch):
    """Each task of an ordered limit sends as many rows as the limit: few more than the sample may reach it."""
    rows = spark.range(40_000, numPartitions=8).select(F.col("id").alias("k"), F.array(F.col("id").cast("double")).alias("__v"))
    want = {r[0] for r in rows.orderBy(F.xxhash64(F.lit(7), "k")).select(F.col("k").cast("double")).take(2_000)}
    reached, seen = [], []
    limit, unique = type(rows).limit, np.unique
    monkeypatch.setattr(type(rows), "limit", lambda df, n: reached.append(df.count()) or limit(df, n))
    monkeypatch.setattr(np, "unique", lambda x, **more: seen.append(x) or unique(x, **more))
    X.fitted(rows, "k", 10, 2_000)
    assert set(seen[0][:, 0]) == want
    assert reached and max(reached) < 5_000
    # keys that repeat hash alike: too few below the cut, so that all are ordered
    same = spark.range(40_000).select(F.lit(5).cast("long").alias("k"), F.array(F.col("id").cast("double")).alias("__v"))
    assert len(X.sampled(same, "k", 40_000, 2_000)) == 2_000
