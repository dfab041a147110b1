"""Density clusters by joins against the tree of one task, in small blocks and contracted to the end."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.operators import cluster as C
from sessionlens.operators import density as D

ROWS = "id long, v array<double>"


def vectors(n, groups=12, size=6, seed=1, noise=0.15):
    """Clusters of several densities in a chain, some rows far from all, some equal, some on a grid (ties)."""
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(groups, size)) * 3
    made = []
    for i in range(n):
        u = rng.random()
        if u < noise:
            made.append(rng.normal(size=size) * 6)
        elif u < noise + 0.05 and made:
            made.append(made[int(rng.integers(len(made)))])
        elif u < noise + 0.15:
            made.append(np.round(rng.normal(size=size) * 1.5))
        else:
            g = int(rng.integers(groups))
            made.append(at[g] + rng.normal(size=size) * (0.1 + 0.1 * (g % 4)))
    return np.array(made)


def wanted(x, least):
    return dict(enumerate(C.leaf_clusters(x, least).tolist()))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], ROWS).repartition(4)


def test_tree_is_the_one_of_one_task(spark):
    x = vectors(300)
    made = frame(spark, x).select(F.col("id").alias("k"), F.col("v").alias("__v"))
    got = sorted((r.d, r.lo, r.hi) for r in D.spanning_tree(made, 3, 48).collect())
    assert got == C._tree(x, 3)


def test_clusters_are_those_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(C, "ONE_TASK", 100)
    x = vectors(300, seed=3)
    got = C.clustered(frame(spark, x), "id", "v", 3).collect()
    want = wanted(x, 3)
    assert {r.id: r.cluster for r in got} == want
    assert max(want.values()) > 3


def folded_to_the_end(n, edges, least):
    made = D._fold({c: (1, D.SMALL) for c in range(n)}, [(d, a, b, a, b) for d, a, b in edges], least)
    names = sorted({v for v in made.values() if v}, key=lambda v: min(c for c, x in made.items() if x == v))
    return {c: names.index(v) if v else -1 for c, v in made.items()}


def test_fold_gives_the_leaves():
    for seed in range(12):
        x = vectors(150, groups=5, size=3, seed=seed)
        least = 2 + seed % 4
        assert folded_to_the_end(len(x), C._tree(x, least), least) == wanted(x, least)


@pytest.mark.parametrize("shape", ["random", "star"])
def test_contraction_gives_the_fold(spark, shape):
    """Trees of any weights, contracted by joins to one component."""
    rng = random.Random(5)
    n, least = 80, 3
    ends = {"random": lambda i: rng.randrange(i), "star": lambda i: 0 if rng.random() < 0.7 else rng.randrange(i)}[shape]
    edges = [(float(rng.randrange(40)), ends(i), i) for i in range(1, n)]
    tree = spark.createDataFrame([(a, b, d) for d, a, b in edges], "lo long, hi long, d double")
    got = {r.k: r.label for r in D.leaf_labels(spark.range(n).withColumnRenamed("id", "k"), tree, least, folded=1).collect()}
    names = sorted({v for v in got.values() if v}, key=lambda v: min(c for c, x in got.items() if x == v))
    assert {k: names.index(v) if v else -1 for k, v in got.items()} == folded_to_the_end(n, edges, least)


def test_few_and_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [float("nan"), 1.0]), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, ROWS)
    assert {r.id: r.cluster for r in D.clustered(df, "id", "v", 3).collect()} == {1: -1, 2: -1, 3: -1, 4: -1}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)] + [(9, None)], ROWS)
    assert {r.cluster for r in D.clustered(same, "id", "v", 3, folded=2).collect()} == {-1}


def test_probes_are_sent_once_for_many_cells(spark):
    """Vectors without clusters reach nearly all cells; what is sent is a row for each pen, not for each cell."""
    x = np.random.default_rng(2).normal(size=(600, 32))
    space = D._Space(frame(spark, x).select(F.col("id").alias("k"), F.lit(0).alias("g"), F.col("v").alias("__v")), 200)
    sent = space.reached(space.rows.withColumn("worst", F.lit(None).cast("double")), [])
    assert len(space.used) > 3 * len(space.pen_rows)
    assert sent.count() == 600 * len(space.pen_rows)


def test_few_rows_ask_beyond_their_lists(spark, monkeypatch):
    asked, meet = [], D._Space.meet
    monkeypatch.setattr(D._Space, "meet", lambda self, probes, *rest: asked.append(probes.select("k").distinct().count()) or meet(self, probes, *rest))
    x = np.random.default_rng(4).normal(size=(400, 16))
    made = frame(spark, x).select(F.col("id").alias("k"), F.col("v").alias("__v"))
    assert sorted((r.d, r.lo, r.hi) for r in D.spanning_tree(made, 3, 100).collect()) == C._tree(x, 3)
    assert asked[:2] == [400, 400] and sum(asked[2:]) < 400


def test_large_groups_share_the_joins_and_small_ones_a_task_each(spark, monkeypatch):
    monkeypatch.setattr(C, "ONE_TASK", 60)
    x, label = vectors(260, seed=6), [None if i % 3 == 0 else i % 3 if i < 240 else 7 for i in range(260)]
    df = spark.createDataFrame([(i, g, v.tolist()) for i, (g, v) in enumerate(zip(label, x, strict=True))], "id long, g int, v array<double>")
    want, tasks = {}, []
    for g in set(label):
        own = [i for i in range(260) if label[i] == g]
        want |= {(g, own[i]): c for i, c in wanted(x[own], 2).items()}
    small = C._small
    monkeypatch.setattr(C, "_small", lambda rows, *rest: tasks.append(rows.groupBy("g").count().agg(F.max("count")).first()[0]) or small(rows, *rest))
    assert {(r.g, r.id): r.cluster for r in C.clustered(df, "id", "v", 2, by="g").collect()} == want
    assert max(tasks) <= 60 and max(want.values()) > 3
