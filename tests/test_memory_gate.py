"""Expectations and the memories that meet them: against brute force, and without pairing all of a name."""

from __future__ import annotations

import random
import re

import pytest

from sessionlens.operators import quality as Q

WORDS = ["a", "an", "And", "the", "then", "theory", "ouen", "of", "nofy", "x", "𝔘nit", "unit", "f(x)", "  "]


def tables(spark, rng):
    text = lambda n: rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(n)), "\t".join(rng.choice(WORDS) for _ in range(n))])
    memories = [(i, text(5), rng.choice([None, "fact", "Goal"])) for i in range(60)] + [(3, "an unit of theory", "goal")]
    sources = [(rng.randrange(70), rng.randrange(25)) for _ in range(90)]
    occurrences = [(rng.choice([None, *range(30)]), rng.randrange(25)) for _ in range(120)]
    entities = [(i, rng.choice([None, "", "One", "one", "Two"])) for i in range(30)]
    expected = [(i, rng.choice([None, "", "ONE", "two", "three"]), rng.choice([None, "", "fact", "goal"]), text(2)) for i in range(80)] + [(1, "one", "", "zz")]
    frames = [(memories, "memory_id int, content string, memory_type string"), (sources, "memory_id int, session_id int"), (occurrences, "entity_id int, session_id int"), (entities, "entity_id int, canonical_name string"), (expected, "expected_id int, entity_name string, memory_type string, content_hint string")]
    return [rows for rows, _ in frames], [spark.createDataFrame(rows, schema) for rows, schema in frames]


def brute(memories, sources, occurrences, entities, expected):
    out: dict = {}
    for e, name, kind, hint in expected:
        if not name or not hint:
            continue
        sessions = {s for i, s in occurrences for j, n in entities if i == j and n and n.lower() == name.lower()}
        words = [w for w in re.split(r"\s+", hint.lower()) if len(w) > 1]
        for m, content, own in memories:
            near = any(m == x and s in sessions for x, s in sources)
            if near and (not words or content is not None and all(w in content.lower() for w in words)) and (not kind or own and own.lower() == kind.lower()):
                out[e] = min(m, out.get(e, m))
    return out


@pytest.mark.parametrize("first", [1, 7, 256])
def test_matched_equals_brute_force(spark, first):
    rows, frames = tables(spark, random.Random(first))
    assert {r["expected_id"]: r["memory_id"] for r in Q.matched(*frames, first=first).collect()} == brute(*rows) != {}


def shuffled(spark) -> int:
    """Rows that all stages so far gave to exchanges."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_expectations_of_one_name_are_not_paired_with_all_memories(spark):
    """3,000 expectations and memories of one name are 9 million pairs."""
    n = 3000
    ids = spark.createDataFrame([(i,) for i in range(n)], "id long")
    word = "concat('w', id % 50, 'q')"
    memories = ids.selectExpr("id AS memory_id", f"{word} AS content", "'fact' AS memory_type")
    sources, occurrences = ids.selectExpr("id AS memory_id", "id AS session_id"), ids.selectExpr("id AS entity_id", "id AS session_id")
    entities, expected = ids.selectExpr("id AS entity_id", "'one' AS canonical_name"), ids.selectExpr("id AS expected_id", "'one' AS entity_name", "'' AS memory_type", f"{word} AS content_hint")
    before = shuffled(spark)
    got = Q.matched(memories, sources, occurrences, entities, expected).where("memory_id = expected_id % 50").count()
    assert got == n and shuffled(spark) - before < n * n / 10


def test_tokens_of_memories_go_through_no_exchange(spark):
    """1,000 memories of 50 tokens each, of which no other memory has one, and a hint of two of them for each memory."""
    n, k = 1000, 50
    ids = spark.range(n).selectExpr("id", f"transform(sequence(0, {k - 1}), i -> concat('w', lpad(id * {k} + i, 6, '0'), 'q')) AS own")
    memories = ids.selectExpr("id AS memory_id", "array_join(own, ' ') AS content", "'fact' AS memory_type")
    sources, occurrences = ids.selectExpr("id AS memory_id", "id AS session_id"), ids.selectExpr("id AS entity_id", "id AS session_id")
    entities = ids.selectExpr("id AS entity_id", "'one' AS canonical_name")
    expected = ids.selectExpr("id AS expected_id", "'one' AS entity_name", "'' AS memory_type", "concat(own[7], ' ', own[9]) AS content_hint")
    before = shuffled(spark)
    assert Q.matched(memories, sources, occurrences, entities, expected).where("memory_id = expected_id").count() == n
    assert shuffled(spark) - before < n * k
