"""The manifest against a plain tree, on odd tables, and its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sessionlens.llm import merkle

DATA = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(root, steps of each node: (left, right) by level)."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 8 * 8 : k // 8 * 8 + 8]
            steps[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        level = [h(*level[k : k + 8]) for k in range(0, len(level), 8)]
        at = [k // 8 for k in at]
    return level[0], steps


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if changed else r[1]
        by[r[2]].append((r[0], leaf_of(*r), leaf_of(r[0], low, *r[2:])))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = tree([r[1] for r in by[lang]])
    root, higher = tree([trees[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for (doc_id, leaf, start), low in zip(by[lang], trees[lang][1], strict=True):
            fold = start
            for left, right in low + higher[k]:
                fold = h(left, fold, right)
            out.append((doc_id, leaf, trees[lang][0], root, h(*(a + b for a, b in low + higher[k])), fold, fold == root))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(9)
    rows = [(None, None, None, None, None), (0, "", "en", "a", 0), (1, "Ünï Big", "en", None, 7), (1, "Ünï Big", "en", None, 7), (1, None, "en", None, 7), (2, "X" * 2_000_000, "de", "a", 1), (None, "No Id", "", "b", 3)]
    rows += [(rng.randrange(-50, 5000), rng.choice(["Up", "low", "MiX é Ä"]) * rng.randint(1, 3), rng.choice(["en", "fr", "zz", "é", None]), "s", 1) for _ in range(700)]
    rows += [(7, "Copy", "cc", "s", 1)] * 70  # equal rows over several runs
    rows += [(k, "A", f"l{k}", "s", 1) for k in range(70)]  # more groups than one run
    return rows


def got_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def asked(spark, tmp_path, rows):
    clash = {c: F.lit(1) for c in ("g", "at", "n", "h", "id", "part", "run", "key", "top", "path", "root", "leaf", "altered")}
    spark.createDataFrame(rows, DOCS).withColumns(clash).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return merkle.op13_merkle_manifest(spark, str(tmp_path))


def test_manifest_of_odd_rows(spark, tmp_path):
    assert got_of(asked(spark, tmp_path, odd_rows())) == expected(odd_rows())


def test_manifest_beyond_what_is_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "SMALL", 0)
    rows = odd_rows()[:300]
    assert got_of(asked(spark, tmp_path, rows)) == expected(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9])
def test_manifest_of_few_rows(spark, tmp_path, n):
    rows = [(k, "Text", "en", "s", 4) for k in range(n)]
    assert got_of(asked(spark, tmp_path, rows)) == (expected(rows) if n else [])


def test_manifest_of_the_table_and_its_sql(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{DATA / 'documents.parquet'}'")
    want = duck.sql(f"select {', '.join(COLUMNS)} from ({merkle.ORACLE_SQL})").fetchall()
    assert got_of(merkle.op13_merkle_manifest(spark, str(DATA))) == sorted(want, key=str)
    rows = [tuple(r) for r in spark.read.parquet(str(DATA / "documents.parquet")).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(want, key=str) == expected(rows)
