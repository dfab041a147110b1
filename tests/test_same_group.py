"""Counts of others in a group against all pairs, without making the pairs."""

from __future__ import annotations

import random

from sessionlens.plans import relational as R

ROWS = "c_custkey int, c_nationkey int, c_mktsegment string"


def test_counts_of_others_equal_those_of_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for _ in range(120)] + [(99, 7, "z"), (99, 7, "z")]
    want: dict = {}
    for a in rows:
        others = sum(None not in a and None not in b and a[1:] == b[1:] and a[0] != b[0] for b in rows)
        if others:
            want[a[0]] = want.get(a[0], 0) + others
    out = R.j10(spark.createDataFrame(rows, ROWS), None)
    assert {r["src"]: r["others"] for r in out.collect()} == want and 99 not in want


def test_no_pairs_are_made(spark):
    """20,000 of one group are 400 million pairs; no operator gives more rows than there are customers."""
    c = spark.range(20_000).selectExpr("int(id) AS c_custkey", "1 AS c_nationkey", "'a' AS c_mktsegment")
    out = R.j10(c, None)
    assert out.where("others = 19999").count() == 20_000
    assert "c_custkey#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "NOT (c_custkey" not in plan
