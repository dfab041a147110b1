"""Conversation repair against a plain search over all edits, on tables and in pieces."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sessionlens.llm import turns

DATA = Path("/root/testdata/sf0.001")
ROWS = "conv_id long, turn long, role string, text string"
STEPS = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}


def searched(rows, insert=5, most_inserts=None):
    """(cost, audit, repaired) of rows (role, text, fault): every edit string is tried, a state's best by cost and audit."""
    best = {0: (0, "", ())}

    def inserted(states):
        for _ in range(2):
            for q, (cost, audit, out) in list(states.items()):
                for r in (2, 3):
                    if (q, r) in STEPS:
                        new = (cost + insert, audit + "I", (*out, (turns.NAMES[r], "")))
                        if r not in states or new[:2] < states[r][:2]:
                            states[r] = new
        return states

    for role, text, fault in rows:
        after = {}

        def offer(q, new, after=after):
            if q not in after or new[:2] < after[q][:2]:
                after[q] = new

        for q, (cost, audit, out) in best.items():
            offer(q, (cost + 2, audit + "D", out))
        for q, (cost, audit, out) in inserted(dict(best)).items():
            if fault in ("blank", "duplicate"):
                continue
            for r in (1, 2, 3):
                if (q, r) in STEPS:
                    more = 5 if fault == "truncated" else 0
                    if role[:1] == " sua"[r]:
                        offer(r, (cost + more, audit + "K", (*out, (role, text))))
                    elif r > 1:
                        offer(r, (cost + more + 1, audit + "R", (*out, (turns.NAMES[r], text))))
        best = after
    return min(v for q, v in inserted(dict(best)).items() if q in (0, 3))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append((role, text, "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def expected(rows):
    """The contract's columns by conversation, from rows (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = convs[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        known = [t for t, _, _ in mine if t is not None]
        items = faults([r[1:] for r in mine])
        cost, audit, kept = searched(items)
        count = lambda f, items=items: sum(x == f for _, _, x in items)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def random_turns(rng, n):
    return [(rng.choice(["system", "user", "assistant", "tool", "", "unknown"]), rng.choice(["a.", "b!", "c?", "d", "e f. ", "", " \n", "g. x", "h" * 9 + "."])) for _ in range(n)]


@pytest.mark.parametrize("insert", [5, 1])
def test_paths_are_cheapest_and_least(monkeypatch, insert):
    monkeypatch.setattr(turns, "INSERT", insert)
    rng = random.Random(insert)
    for _ in range(600):
        items = faults(random_turns(rng, rng.randint(0, 12)))
        made = [turns.Turn(r, t, f == "duplicate", 1) for r, t, f in items]
        paths = turns.Paths(made, [insert * m for m in turns.AT_END])
        edits = list(paths.walk(turns.NONE))
        got = paths.cost(turns.NONE), turns.audit(edits), tuple((r, t) for _, r, t in turns.lines(made, edits))
        assert got == searched(items, insert)


def odd_rows():
    rng = random.Random(8)
    rows = [(c, t, *x) for c in range(60) for t, x in enumerate(random_turns(rng, rng.randint(1, 9)))]
    rows += [(None, t, r, x) for t, (r, x) in enumerate(random_turns(rng, 7))]
    rows += [(100, None, "user", "a."), (100, None, "user", "a."), (100, 3, None, None), (100, 3, "assistant", None), (101, 5, "user", "x" * 300_000 + "."), (101, 6, "assistant", "ok.")]
    rows += [(102, 1, "user", "same.")] * 40 + [(102, 2, "assistant", "yes.")] * 3 + [(102, 9, "user", "same.")]
    rows += [(103, t, *x) for t, x in enumerate(random_turns(rng, 700))]  # over many pieces
    rows += [(104 + k, t, "user", "") for k in range(4) for t in (0, 7)]
    return rows


def table_of(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


@pytest.fixture
def asked(spark, tmp_path):
    def ask(rows):
        df = spark.createDataFrame(rows, ROWS) if isinstance(rows, list) else rows
        df.withColumns({c: F.lit(1) for c in ("id", "copies", "piece", "same", "audit", "gaps")}).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
        return turns.op11_structure_repair(spark, str(tmp_path))

    return ask


@pytest.mark.parametrize("piece", [4096, 5])
def test_repair_of_odd_tables(asked, monkeypatch, piece):
    monkeypatch.setattr(turns, "PIECE_ROWS", piece)
    monkeypatch.setattr(turns, "PIECE_CHARS", 1 << 20)
    assert table_of(asked(odd_rows())) == expected(odd_rows())


def test_repair_of_the_table(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    rows = [tuple(r) for r in spark.read.parquet(str(DATA / "conversations.parquet")).select("conv_id", "turn", "role", "text").collect()]
    assert table_of(turns.op11_structure_repair(spark, str(DATA))) == expected(rows)


def test_sql_of_odd_rows():
    import duckdb

    duck = duckdb.connect()
    duck.sql("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    rows = [r for r in odd_rows() if r[0] != 103]
    duck.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in duck.sql(turns.ORACLE_SQL).fetchall()} == expected(rows)


def test_repair_of_nothing(asked):
    assert asked([]).count() == 0


def test_dropped_conversation(asked):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert table_of(asked([(conv, 0, "user", "hi.")])) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns(spark):
    rows = [(1, 1, "user", "q.", 1), (1, 2, "user", "a.", 1), (1, 3, "user", "", 1), (2, 1, "system", "s.", 1), (2, 2, "user", "q.", 2), (2, 3, "assistant", "a.", 1)]
    got = turns.repaired(spark.createDataFrame(rows, ROWS + ", copies long")).orderBy("conv_id", "piece", "place").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in got] == [(1, "K", "user", "q."), (1, "R", "assistant", "a."), (2, "K", "system", "s."), (2, "K", "user", "q."), (2, "K", "assistant", "a.")]
