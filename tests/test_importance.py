"""Forest importances: a planted feature comes first, they sum to one, odd rows count as stated."""

from __future__ import annotations

import random

import pytest

from sessionlens.operators.importance import feature_importance

ROWS = "kind string, planted double, noise double, steady long"


def test_planted_feature_is_first(spark):
    rng = random.Random(1)
    rows = [(("a", "b", "c")[i % 3], i % 3 + rng.random() * 0.3, rng.random(), 4) for i in range(300)]
    rows += [(None, 50.0, 1.0, 4), ("a", None, float("nan"), None), ("b", float("inf"), None, 4)]
    df = spark.createDataFrame(rows, ROWS)
    got = [tuple(r) for r in feature_importance(df, "kind", ["noise", "planted", "steady"], trees=20).collect()]
    assert got[0][0] == "planted"
    assert sum(x for _, x in got) == pytest.approx(1)
    assert dict(got)["steady"] < 0.02
    assert got == [tuple(r) for r in feature_importance(df, "kind", ["noise", "planted", "steady"], trees=20).collect()]


def test_nothing_to_tell_apart(spark):
    one = spark.createDataFrame([("a", 1.0, 2.0, 3)] * 5, ROWS)
    assert {r.importance for r in feature_importance(one, "kind", ["planted", "noise"]).collect()} == {0.0}
    assert feature_importance(one.limit(0), "kind", ["planted"]).count() == 0
