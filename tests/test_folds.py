"""Folds give the same at any batch size, and hold no session's rows."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import pytest

from sessionlens.operators import exchanges as X
from sessionlens.operators import trajectory as TR
from sessionlens.operators.folds import Packed, Spaced, UpperMedian, carried

ROWS = "s string, at long, x long, extra array<string>"


@pytest.fixture(params=["1", "7", "10000"])
def batches(spark, request):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield spark
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def rows():
    rng = random.Random(3)
    made = [(f"s{k}", i, rng.choice([None, rng.randrange(900)]), ["a"]) for k in range(5) for i in range(rng.randrange(1, 40))]
    return made + [(None, i, i % 7, None) for i in range(20)]


def by_session(found):
    out = defaultdict(list)
    for r in sorted(found, key=lambda r: (r[0] is not None, r[0], r[1])):
        out[r[0]].append(tuple(r))
    return out


def test_running_median(batches):
    df = batches.createDataFrame(rows(), ROWS).repartition(3)
    got = by_session(carried(df, "s", ["at"], ["x"], UpperMedian, "median", "bigint").collect())
    for session, mine in by_session(rows()).items():
        for i, r in enumerate(got[session]):
            seen = sorted(x[2] for x in mine[: i + 1] if x[2] is not None)
            assert r[:4] == mine[i]
            assert r[4] == (seen[len(seen) // 2] if seen else None)


def test_packing_spans_batches(batches):
    df = batches.createDataFrame([(s, i, x) for s, i, x, _ in rows()], "conv_id string, exchange long, tokens long").repartition(3)
    got = defaultdict(list)
    for r in X.packed_chunks(df).orderBy("chunk_index").collect():
        got[r[0]].append(tuple(r)[1:])
    for session, mine in by_session(rows()).items():
        want, run = [], []
        for _, i, x, _ in mine:
            size = x or 0
            if size > X.MAX_TOKENS or not run or sum(t for _, t in run) + size > X.MAX_TOKENS or run[-1][1] > X.MAX_TOKENS:
                run = []
                want.append(run)
            run.append((i, size))
        assert [(a, b, c, d or 0) for a, b, c, d in got[session]] == [(k, r[0][0], r[-1][0], sum(t for _, t in r)) for k, r in enumerate(want)]


def test_spacing_spans_batches(batches):
    df = batches.createDataFrame([(s, i, x) for s, i, x, _ in rows()], "s string, at long, x long").repartition(3)
    got = sorted((r.s or "", r.at) for r in TR.spaced(df, "s", "at", ["-x", "at"], 3, 5).collect())
    want = []
    for session, mine in by_session(rows()).items():
        pick = Spaced(3, 5)
        for r in sorted(mine, key=lambda r: (r[2] is None, -(r[2] or 0), r[1])):
            if pick(r[1]):
                want.append((session or "", r[1]))
    assert got == sorted(want)


def test_a_million_turns():
    median, packed, t = UpperMedian(), Packed(800), time.time()
    for i in range(1_000_000):
        last = median(i * 7919 % 1_000_003)
        packed(i % 300)
    assert time.time() - t < 30
    assert last == sorted(i * 7919 % 1_000_003 for i in range(1_000_000))[500_000]
