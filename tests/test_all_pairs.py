"""Relations of all rows, not those of a query set; pairs told once without grouping against grouped ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import graph as G
from sessionlens.plans import relational, search


def occurrences(spark):
    rng = random.Random(7)
    rows = [(s := rng.randrange(60), s * 10 + rng.randrange(3), rng.choice([None, 0, *range(25)])) for _ in range(300)]
    rows += [(7, 71, e) for e in range(25)] + [(None, None, 3), (5, None, 4)]
    return spark.createDataFrame(rows, "session_id int, record_id int, entity_id int")


def every_pair(df, key):
    have: dict = {}
    for r in df.dropna(subset=[key, "entity_id"]).collect():
        have.setdefault(r[key], set()).add(r["entity_id"])
    return {(a, b): have[a] & have[b] for a in have for b in have if a != b and have[a] & have[b]}


@pytest.mark.parametrize("most", [0, 4, 64])
def test_each_pair_once_with_all_that_it_shares(spark, most):
    occ = occurrences(spark)
    got = [(r["src"], r["tgt"], set(r["shared"])) for r in G.pairs_sharing(occ, "session_id", "entity_id", most).collect()]
    assert len(got) == len({x[:2] for x in got})
    assert {(a, b): s for a, b, s in got} == every_pair(occ, "session_id")


def test_chunks_of_all_ids(spark):
    occ = occurrences(spark)
    got = [tuple(r) for r in relational.j9(occ).collect()]
    assert sorted(got) == sorted(every_pair(occ, "record_id")) and any(a % 100 for a, _ in got)


def test_edges_as_pairs_of_sessions(spark):
    occ = occurrences(spark)
    got = [(r["src"], r["tgt"], r["via"]) for r in search.g1(occ).collect()]
    assert sorted(got) == sorted((a, b, e) for (a, b), s in every_pair(occ, "session_id").items() for e in s)


def test_shared_memories_as_pairs_of_sessions(spark):
    links = occurrences(spark).dropna()
    c, x = links.selectExpr("entity_id AS cluster_id", "record_id AS member_id").distinct(), links.selectExpr("record_id AS memory_id", "session_id").distinct()
    got = [(r["src"], r["tgt"], r["cluster_id"]) for r in search.g4(c, x).collect()]
    assert sorted(got) == sorted((a, b, e) for (a, b), s in every_pair(links, "session_id").items() for e in s)


def test_pairs_of_a_hub_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(G, "PART", 50)
    c = spark.range(400).selectExpr("int(id) AS c", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS g")
    out = G.group_edges(c, "c", "g")
    rows = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(rows) == 2 * 200 * 199 and max(rows) < sum(rows) / 2
    assert out.distinct().count() == sum(rows)
    assert G.shared_edges(c, "c", "g").select("src", "tgt", "weight").exceptAll(out).isEmpty()


def test_sessions_of_all_ids(spark):
    occ = occurrences(spark)
    got = {(r["src"], r["tgt"]): r["shared"] for r in search.j11(occ).collect()}
    assert got == {k: len(s) for k, s in every_pair(occ, "session_id").items()}


def test_reasons_of_all_ids(spark):
    occ = occurrences(spark)
    names = {e: None if e == 3 else f"n{e % 6}" for e in range(25)}
    ent = spark.createDataFrame(list(names.items()), "entity_id int, canonical_name string")
    got = {(r["src"], r["tgt"]): (r["reasons"], r["named"]) for r in search.r13(occ, ent).collect()}
    want = {k: sorted({names[e] for e in s if names[e]}) for k, s in every_pair(occ, "session_id").items()}
    assert got == {k: (len(w), ", ".join(w[:5])) for k, w in want.items()}
