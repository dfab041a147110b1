"""Packing: the reduction keeps the least number of sequences, pieces are the library's ids, every place is filled once."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.llm import packing

DATA = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string"


def placed_once(counts, plan):
    """Every piece of every length has one place; sequences have no gaps and hold `most` at most."""
    sequences, seen = {}, set()
    for r in plan.runs:
        for k in range(r.pieces):
            sequences.setdefault(r.sequence + k // r.each, []).append((r.offset + k % r.each * r.length, r.length))
            seen.add((r.length, r.rank + k))
    assert seen == {(length, k) for length, n in counts.items() for k in range(n)}
    assert sorted(sequences) == list(range(plan.sequences))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= plan.most


def least_sequences(items, most):
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= items[i]:
                k = rooms.index(room)
                go(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, most - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best


def bound(lengths, most=4096):
    """Sequences that no packing can do without: for each k, pieces above most - k stand alone, those above half each
    in one of their own, and those from k on must find room."""
    best = 0
    for k in sorted({x for x in lengths if 2 * x <= most} | {0}):
        alone = sum(x > most - k for x in lengths)
        own = [x for x in lengths if most < 2 * x <= 2 * (most - k)]
        rest = sum(x for x in lengths if k <= x and 2 * x <= most)
        best = max(best, alone + len(own) + max(0, math.ceil((rest - (len(own) * most - sum(own))) / most)))
    return best


class Reduced(packing.Plan):
    def fill(self):
        pass


def test_reduction_keeps_the_optimum():
    rng, above, fixed = random.Random(3), 0, 0
    for _ in range(500):
        most = rng.choice([10, 20, 50])
        low = rng.choice([1, most // 4, most // 3])
        items = [rng.randint(low, most) for _ in range(rng.randint(0, 9))]
        counts = Counter(items)
        optimum = least_sequences(items, most)
        half = Reduced(counts, most)
        rest = [s for s in range(most + 1) for _ in range(int(half.left[s]))]
        assert half.sequences + least_sequences(rest, most) == optimum
        fixed += half.fixed
        plan = packing.Plan(counts, most)
        placed_once(counts, plan)
        above += plan.sequences > optimum
    assert fixed > 500
    assert above <= 5


@pytest.mark.parametrize("kind", ["documents", "long", "even"])
def test_plan_of_many_pieces_is_small_and_near_the_bound(kind):
    rng = random.Random(5)
    make = {"documents": lambda: min(4096, max(1, int(rng.lognormvariate(6.3, 1.2)))), "long": lambda: rng.randint(1000, 4096), "even": lambda: rng.randint(1, 4096)}[kind]
    counts = Counter(make() for _ in range(50_000))
    counts[7] += 1_000_000  # one length that holds most of the pieces
    plan = packing.Plan(counts)
    placed_once(counts, plan)
    assert len(plan.runs) < 12 * 4 * 4096
    most_bound = max(math.ceil(sum(s * n for s, n in counts.items()) / 4096), sum(n for s, n in counts.items() if s > 2048))
    assert plan.sequences <= 1.05 * most_bound


def rows():
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}é" for _ in range(n))
    made = [(k, words(rng.choice([1, 5, 60, 400]))) for k in range(80)]
    return made + [(80, None), (81, ""), (None, words(30)), (82, words(60_000)), (83, " ".join(["the"] * 4095)), (84, " ".join(["the"] * 4096)), (85, "x" * 100_000)] + [(86, "same text")] * 50


def test_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(rows(), DOCS).withColumns({c: F.lit(1) for c in ("length", "task", "nth", "rank", "ids", "offset")}).repartition(3)
    tokenizer = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END] for d, t in rows()}
    want = Counter()
    for d, _ in rows():
        for k, at in enumerate(range(0, len(ids[d]), 4096)):
            part = ids[d][at : at + 4096]
            want[d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.packed(packing.pieces(docs)).toPandas()
    found = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert found == want
    assert got.sequence_id.nunique() <= bound(got.length.tolist()) + 1
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset == part.length.cumsum() - part.length).all()
        assert part.length.sum() <= 4096
    made = packing.sequences(docs).collect()
    assert len(made) == got.sequence_id.nunique()
    assert Counter(i for r in made for i in r.ids) == Counter(i for d, _ in rows() for i in ids[d])
    assert max(len(r.ids) for r in made) <= 4096


def test_packing_of_nothing(spark):
    assert packing.packed(packing.pieces(spark.createDataFrame([], DOCS))).count() == 0


def test_packing_of_the_table(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    got = packing.op12_best_fit_packing(spark, str(DATA)).toPandas()
    total = int(got.length.sum())
    assert got.sequence_id.nunique() == math.ceil(total / 4096)
