"""The cosine join against all pairs, in blocks of few rows and in cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.operators import graph as G
from sessionlens.operators import similarity as S

ROWS = "id long, v array<double>"


def clustered(n, groups, size=16, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(groups, size))
    return [(i, (at[i % groups] + rng.normal(size=size) * spread).tolist()) for i in range(n)]


def all_pairs(rows, top_k, least):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(x @ x.T, 12)
    np.fill_diagonal(sim, -3)
    out = {}
    for i, s in enumerate(sim):
        hit = np.flatnonzero(s >= least)
        hit = hit[np.lexsort((hit, -s[hit]))][:top_k]
        out |= {(rows[i][0], rows[h][0]): s[h] for h in hit}
    return out


def edges_of(df):
    return {(r.src, r.tgt): r.weight for r in df.collect()}


@pytest.mark.parametrize(("block", "top_k", "least"), [(2048, 8, 0.5), (40, 8, 0.5), (40, 3, 0.99), (2048, 200, 0.2)])
def test_edges_are_those_of_all_pairs(spark, block, top_k, least):
    rows = clustered(900, 30)
    made = S.unit(spark.createDataFrame(rows, ROWS), "id", "v")
    join = S.CosineJoin(made, made, top_k, least, block)
    want = all_pairs(rows, top_k, least)
    got = edges_of(join.edges)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    if top_k <= 8:
        assert join.compared < 0.2 * len(rows) ** 2


def test_edges_of_odd_rows(spark):
    rows = clustered(200, 5) + [(300 + k, [1.0] * 16) for k in range(30)]  # equal ones tie
    odd = [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] * 16)]
    got = edges_of(G.similarity_edges(spark.createDataFrame(rows + odd, ROWS), "id", "v", 4, 0.6))
    assert got.keys() == all_pairs(rows, 4, 0.6).keys()
    assert G.similarity_edges(spark.createDataFrame([], ROWS), "id", "v").count() == 0
    assert G.similarity_edges(spark.createDataFrame(rows[:1], ROWS), "id", "v").count() == 0


def test_spread_without_pairs(spark):
    rows = clustered(400, 12, spread=0.4)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = (x @ x.T)[np.triu_indices(len(x), 1)]
    df = spark.createDataFrame(rows, ROWS)
    assert S.extremes(df, "id", "v") == pytest.approx((pairs.min(), pairs.max()), abs=1e-9)
    assert S.mean_cosine(df, "id", "v") == pytest.approx(pairs.mean(), abs=1e-9)
    assert S.extremes(df.limit(0), "id", "v") == (None, None)
    assert S.mean_cosine(df.where(F.col("id") < 1), "id", "v") is None


@pytest.mark.parametrize("block", [None, 70])
def test_pairs_above_a_threshold_are_sent_on_by_no_exchange(spark, block):
    rows = clustered(300, 9, spread=0.6) + [(400, None), (401, [0.0] * 16)]
    got = S.pairs_above(spark.createDataFrame(rows, ROWS), "id", "v", 0.3, block)
    want = {k: v for k, v in all_pairs(rows[:300], 300, 0.3).items() if k[0] < k[1]}
    assert {(r.src, r.tgt): pytest.approx(r.weight, abs=1e-9) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_spread_in_blocks_without_a_join_of_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "CosineJoin", None)
    rows = clustered(200, 7, spread=0.4)
    df = spark.createDataFrame(rows, ROWS)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = (x @ x.T)[np.triu_indices(len(x), 1)]
    assert S.extremes(df, "id", "v", 45) == pytest.approx((pairs.min(), pairs.max()), abs=1e-9)


def test_a_probe_is_sent_once_for_many_cells(spark, monkeypatch):
    rows = np.random.default_rng(1).normal(size=(500, 32))
    made = S.unit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], ROWS), "id", "v")
    sent, products = [], S.CosineJoin._products
    monkeypatch.setattr(S.CosineJoin, "_products", lambda self, probes: sent.append(probes.count()) or products(self, probes))
    S.CosineJoin(made, made, 4, 0.01, 200).edges.count()
    assert sent[0] == 500 and sent[1] <= 500 * 4
