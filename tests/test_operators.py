"""Properties of single operators on small tables."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.functions import text as T
from sessionlens.functions.ordering import at_positions
from sessionlens.functions import vectors as V
from sessionlens.operators import cluster as C
from sessionlens.operators import entities as E
from sessionlens.operators import exchanges as X
from sessionlens.operators import graph as G
from sessionlens.operators import postings as P
from sessionlens.operators import quality as Q
from sessionlens.operators import retrieval as R
from sessionlens.operators import seams as S
from sessionlens.operators import trajectory as TR
from sessionlens.sources import harness as H
from sessionlens.sources import batches as BT
from sessionlens.sources import tables as TB
from sessionlens.streaming import incremental as INC


def leg(spark, ids):
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)] or [("x", 1)], "id string, rank int").where("true" if ids else "false")


def naive_rrf(lex, sem, k):
    scores = {}
    for ids in (lex, sem):
        for r, x in enumerate(ids, 1):
            scores[x] = scores.get(x, 0.0) + 1 / (60 + r)
    ranked = sorted(scores.items(), key=lambda x: -x[1])
    chosen, firsts = ranked[:k], [x[0] for x in (lex, sem) if x]
    for g in firsts:
        if g in {x for x, _ in chosen}:
            continue
        for i in range(len(chosen) - 1, -1, -1):
            if chosen[i][0] not in firsts:
                chosen.pop(i)
                chosen.append((g, scores[g]))
                break
    return {x for x, _ in chosen}


@pytest.mark.parametrize(
    ("lex", "sem", "k"),
    [
        (["a", "b"], ["b", "c"], 2),
        (["c1", "c2", "c3", "c4", "c5"], ["z", "x1", "c1", "c2", "c3", "c4", "c5"], 5),
        (["a"], ["b"], 1),
        ([], ["b", "c"], 2),
        (["a", "b", "c"], [], 2),
    ],
)
def test_rrf(spark, lex, sem, k):
    got = [r["id"] for r in R.rrf(leg(spark, lex), leg(spark, sem), "id", k).collect()]
    assert set(got) == naive_rrf(lex, sem, k)


def test_rrf_random(spark):
    rng = random.Random(5)
    for _ in range(6):
        ids = [f"d{i:02d}" for i in range(14)]
        lex, sem = rng.sample(ids, 8), rng.sample(ids, 8)
        got = {r["id"] for r in R.rrf(leg(spark, lex), leg(spark, sem), "id", 5).collect()}
        want = naive_rrf(lex, sem, 5)
        score = lambda s: sorted(round(sum(1 / (60 + x.index(i) + 1) for x in (lex, sem) if i in x), 12) for i in s)
        assert score(got) == score(want)


def test_bm25_and_query_terms(spark):
    docs = spark.createDataFrame([(1, "PDF rendering blocked by JavaScript"), (2, "entity extraction uses a model"), (3, None), (4, "rendering rendering")], "id int, text string")
    assert T.query_terms("The PDF of an at rendering") == ["pdf", "rendering"]
    got = [r["id"] for r in R.bm25(docs, "id", "text", "pdf rendering", 5).collect()]
    assert got[0] == 1 and set(got) == {1, 4}
    assert R.bm25(docs, "id", "text", "the of", 5).count() == 0
    assert [r["id"] for r in R.bm25(docs, "id", "text", "extracted models", 5, stem=True).collect()] == [2]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("sky", "sky"), ("adjustment", "adjust"), ("controll", "control"), ("formalize", "formal")])
def test_porter(word, stem):
    assert T._stem(word) == stem


def test_walk_matches_brute_force(spark):
    rng = random.Random(2)
    edges = [(a, b, rng.choice([0.1, 0.3, 0.5, 0.9])) for a in range(30) for b in rng.sample(range(30), 4) if a != b]
    sources = [(m, m % 30) for m in range(60)]
    e, s = spark.createDataFrame(edges, "src int, tgt int, weight double"), spark.createDataFrame(sources, "memory_id int, session_id int")
    m = spark.createDataFrame([(i, i % 7, i % 3) for i in range(60)], "memory_id int, evidence int, access int")
    seen, front = {3}, [3]
    for _ in range(2):
        cand = {}
        for a, b, w in edges:
            if a in front and b not in seen and w > 0.2:
                cand[b] = max(w, cand.get(b, 0))
        front = [b for b, _ in sorted(cand.items(), key=lambda x: (-x[1], x[0]))[:10]]
        seen |= set(front)
    want = sorted((x for x, sess in sources if sess in seen - {3} and x != 3), key=lambda i: (-(i % 7), -(i % 3), i))[:30]
    assert [r["memory_id"] for r in R.graph_walk(e, s, m, 3, 2).collect()] == want


def test_similarity_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0])], "id int, v array<double>")
    got = {(r["src"], r["tgt"]) for r in G.similarity_edges(rows, "id", "v", 8, 0.5).collect()}
    assert got == {(1, 2), (2, 1)}
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(10)], "id int, v array<double>")
    assert {r["count"] for r in G.similarity_edges(same, "id", "v", 3, 0.5, block=4).groupBy("src").count().collect()} == {3}


def test_leaf_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.01, (6, 4)), rng.normal(3, 0.01, (6, 4))])
    labels = C.leaf_clusters(x, 3)
    assert set(labels[:6]) - {-1} == {0} and set(labels[6:]) - {-1} == {1}
    assert (C.leaf_clusters(x[:1], 2) == -1).all()


def test_superseded(spark):
    old = spark.createDataFrame([("o1", i) for i in range(3)] + [("o2", i) for i in range(10, 14)], "old_cluster string, member int")
    new = spark.createDataFrame([("n1", i) for i in (0, 1, 2, 3, 10)], "new_cluster string, member int")
    assert [tuple(r) for r in C.superseded(new, old).collect()] == [("o1", "n1")]


def test_names_resolve_in_order(spark):
    """Against the plain fold: a mention meets canonical names only, the first of them within two edits wins."""
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))), "person" if i % 3 else "org") for i in range(120)]
    rows += [(200, "annabel", "tool"), (201, "annabelxy", "tool"), (202, "Annabelxyzw", "tool"), (203, "ANNABEL", "tool"), (204, None, "tool")]
    pairs = spark.createDataFrame(sorted({(a[1].lower(), b[1].lower()) for a in rows for b in rows if a[1] is not None and b[1] is not None}), "a string, b string")
    near = {(r[0], r[1]) for r in pairs.where(F.levenshtein("a", "b") <= 2).collect()}
    made, want = [], {}
    for i, name, kind in rows:
        if name is not None:
            hit = next((j for j, n, k in made if k == kind and (name.lower(), n) in near), None)
            want[i] = i if hit is None else hit
            if hit is None:
                made.append((i, name.lower(), kind))
    df = spark.createDataFrame(rows, "mention_id int, name string, entity_type string")
    assert dict(map(tuple, E.resolved_in_order(df).collect())) == want
    assert (want[201], want[202], want[203]) == (200, 202, 200)
    assert E.resolved_in_order(df.limit(0)).count() == 0


def test_batches_keep_rows_of_composite_keys(spark, tmp_path):
    sources = spark.createDataFrame([("m1", "s1"), ("m1", "s2"), ("m2", "s1"), ("m1", "s1")], TB.SCHEMAS["memory_sources"])
    edges = spark.createDataFrame([("a", "b", "structural", "e1", 1.0), ("a", "c", "structural", "e1", 1.0), ("a", "b", "workspace", None, 0.5)], TB.SCHEMAS["session_graph_edges"])
    scores = spark.createDataFrame([("s", i, 0.1, 1.0, 0.0, "{}") for i in range(3)], TB.SCHEMAS["step_scores"])
    other = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 2, "z")], "a int, b int, c string")
    batch = {"memory_sources": sources, "session_graph_edges": edges, "step_scores": scores, "other": other}
    for _ in range(2):
        BT.written_session(batch, str(tmp_path), {"other": ["a", "b"]})
    assert {n: BT.table(spark, str(tmp_path), n).count() for n in batch} == {"memory_sources": 3, "session_graph_edges": 3, "step_scores": 3, "other": 2}
    BT.written_session({"memory_sources": spark.createDataFrame([("m1", "s3"), ("m2", "s1")], TB.SCHEMAS["memory_sources"])}, str(tmp_path))
    assert BT.table(spark, str(tmp_path), "memory_sources").count() == 4


def test_shared_types(spark):
    raw = ["Framework", "algorithm", " project", "org", "TOOL", "dataset", "model", "person", "file", "commit", "pr", "concept", "technology", "library", "", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").select("i", E.shared_type(F.col("x"))).collect()
    assert [r[1] for r in sorted(got)] == ["technology", "concept", "technology", "org", "technology", "dataset", "model", "person", "file", "commit", "pr", "concept", "technology", "concept", "concept", "concept"]


def test_confidence_never_drops(spark):
    chunks = spark.createDataFrame([(1, "s", "r1"), (1, "s", "r2"), (2, "s", "r1"), (3, "s", "r1"), (3, "s", "r2")], "entity_id int, session_id string, record_id string")
    now = spark.createDataFrame([(1, "raw"), (2, "raw"), (3, "corpus"), (4, "session")], "entity_id int, confidence string")
    assert dict(map(tuple, E.confidence_after(chunks, now).collect())) == {1: "session", 2: "raw", 3: "corpus", 4: "session"}


def naive_chunks(tokens, limit=800):
    out, acc, start = [], 0, None
    for i, t in enumerate(tokens):
        if t > limit:
            if start is not None:
                out.append((start, i - 1, acc))
            out.append((i, i, t))
            acc, start = 0, None
        elif start is not None and acc + t > limit:
            out.append((start, i - 1, acc))
            acc, start = t, i
        else:
            start = i if start is None else start
            acc += t
    return out + ([(start, len(tokens) - 1, acc)] if start is not None else [])


def test_packed_chunks(spark):
    rng = random.Random(3)
    for n in (1, 5, 40):
        tokens = [rng.choice([50, 300, 700, 900]) for _ in range(n)]
        df = spark.createDataFrame([("s", i, t) for i, t in enumerate(tokens)], "s string, exchange long, tokens long")
        got = [tuple(r)[2:] for r in X.packed_chunks(df, "s").orderBy("chunk_index").collect()]
        assert got == naive_chunks(tokens)


def test_windows_end_with_the_text(spark):
    df = spark.createDataFrame([(1, "x" * 25), (2, "ab"), (3, "")], "id int, t string")
    got = X.windows(df, "t", 10, 2, ["id"]).collect()
    assert [len(r["piece"]) for r in sorted(got) if r["id"] == 1] == [10, 10, 9]
    assert {r["id"] for r in got} == {1, 2, 3}


def _turns(spark, rows):
    return spark.createDataFrame([("s", i, w, m, [t], [f"{t}::{g}"], [e]) for i, (w, m, t, g, e) in enumerate(rows)], "s string, i long, user_word_count long, model_turn_count long, tools array<string>, targets array<string>, errors array<boolean>")


WINDOW, Z, LOOKBACK = TR.WINDOW, TR.Z, TR.LOOKBACK


def naive_episodes(pdf, order):
    rows, out, looping = pdf.sort_values("turn_index").to_dict("records"), [], False
    for i, r in enumerate(rows):
        if i < WINDOW or r["strength"] < Z:
            continue
        d, z = r["dominant_feature"], r["dominant_z"]
        up = z > 0
        kind = None
        if (d == "model_turn_count" and up and r["read_only_ratio"] > 0.6) or (d == "read_only_ratio" and up):
            kind = "agent_thrash"
        elif d == "action_target_recurrence" and up:
            kind = "loop_entry"
        elif d == "action_entropy" and z:
            kind = ("loop_exit" if looping else "strategy_pivot") if up else "loop_entry"
        elif d == "error_rate" and up and r["error_rate"] > 0.5:
            kind = "escalation"
        elif d == "user_turn_length_ratio" and z < 0 and r["user_turn_length_ratio"] < 0.5:
            kind = "user_correction"
        if kind is None:
            continue
        if kind == "loop_exit":
            looping = False
            if out and out[-1]["inflection_type"] == "loop_entry":
                out[-1]["exit_turn"] = i
            continue
        cause = max(0, i - 1)
        for j in range(i - 1, max(0, i - LOOKBACK) - 1, -1):
            after = rows[j + 1 if j + 1 < i else j]["action_target_recurrence"]
            if (rows[j]["error_rate"] > 0 and (j == 0 or rows[j - 1]["error_rate"] == 0)) or (rows[j]["action_target_recurrence"] == 0 and after > 0):
                cause = j
                break
        looping = looping or kind == "loop_entry"
        out.append({"inflection_type": kind, "precipitating_turn": cause, "entry_turn": i, "exit_turn": None if kind == "loop_entry" else i, "entry_exchange": r[order], "signal_strength": round(r["strength"], 3), "dominant_feature": d})
    return out


def test_inflections_match_a_plain_fold(spark):
    rng = random.Random(11)
    rows = []
    for s in range(12):
        for i in range(60):
            busy = (i // 15) % 2
            rows.append((f"s{s}", i, rng.choice([2, 5, 20, 21]), rng.choice([1, 1, 9]), [rng.choice(["Read", "Edit", "Bash"]) if busy else "Edit"], [f"g{rng.randrange(3 if busy else 30)}"], [rng.random() < 0.2 + 0.5 * busy]))
    turns = spark.createDataFrame(rows, "s string, i long, user_word_count long, model_turn_count long, tools array<string>, targets array<string>, errors array<boolean>")
    feats = TR.dominant(TR.turn_features(turns, "s", "i")).toPandas()
    want = sorted((s, e["inflection_type"], e["precipitating_turn"], e["entry_turn"], -1 if e["exit_turn"] is None else e["exit_turn"]) for s, pdf in feats.groupby("s") for e in naive_episodes(pdf, "i"))
    got = sorted((r["s"], r["inflection_type"], r["precipitating_turn"], r["entry_turn"], -1 if r["exit_turn"] is None else r["exit_turn"]) for r in TR.inflections(turns, "s", "i").collect())
    assert got == want and len({k for _, k, *_ in got}) >= 3


def test_inflections(spark):
    varied = [(20, 1, f"t{i}", f"g{i}", False) for i in range(10)]
    stuck = [(20, 1, "edit", "same", True) for _ in range(10)]
    kinds = {r["inflection_type"] for r in TR.inflections(_turns(spark, varied + stuck), "s", "i").collect()}
    assert "loop_entry" in kinds
    assert TR.inflections(_turns(spark, varied[:5]), "s", "i").count() == 0
    short = [(20, 1, "t", "g", False)] * 10 + [(2, 1, "t", "g", False)]
    assert "user_correction" in {r["inflection_type"] for r in TR.inflections(_turns(spark, short), "s", "i").collect()}


def test_critical_steps_pinned(spark):
    scores = [0.1, 0.1, 0.1, 0.1, 0.9, 0.2, 0.95, 0.96]
    rows = spark.createDataFrame([("s", i, x, 0.5, "0%", False) for i, x in enumerate(scores)], "s string, i int, score double, tokens double, error_bucket string, parse_failed boolean")
    got = {r["i"]: r["tag"] for r in TR.critical_steps(rows, "s", "i", calibrate=False, corroborate=False).collect()}
    assert got[4] == "recovery_critical" and got[5] == "failure_critical" and got[0] == "failure_critical" and got[6] == "recovery_critical" and got[7] == "success_critical"


def test_critical_thresholds(spark):
    rng = random.Random(3)
    scores = {s: [rng.choice([None, 0.2, 0.4, 0.5, 0.9, 0.95]) for _ in range(n)] for s, n in (("a", 40), ("b", 5), ("c", 4), ("d", 1))}
    scores["e"] = [None, None]
    rows = spark.createDataFrame([(s, i, x, 0.5, "0%", x is None) for s, v in scores.items() for i, x in enumerate(v)], "s string, i int, score double, tokens double, error_bucket string, parse_failed boolean")
    got = {r["s"]: (r["eff_low"], r["eff_high"]) for r in TR.critical_steps(rows, "s", "i").collect()}
    for s, v in scores.items():
        v = sorted(x for x in v if x is not None)
        n = len(v)
        want = (max(0.35, v[max(int(n * 0.2) - 1, 0)]), max(0.80, v[min(n - 1, int(n * 0.8))])) if n >= 5 else (0.35, 0.80)
        assert got[s] == want


def test_at_positions(spark):
    rng = random.Random(5)
    groups = {"a": [rng.randrange(1000) for _ in range(3000)], "b": [7] * 500, None: [1, None, 3], "d": [rng.choice([1, 2, None]) for _ in range(50)], "e": [9], "f": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v int")
    places = {"low": lambda n: F.floor(n * 0.2), "last": lambda n: n - 1}
    got = {r["k"]: (r["low"], r["last"]) for r in at_positions(df, "k", "v", places, buckets=8).collect()}
    for k, vs in groups.items():
        vs = sorted(vs, key=lambda v: (v is not None, v))
        assert got[k] == (vs[int(len(vs) * 0.2)], vs[-1])


def test_stored_postings(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights=range(60, 0, -1), k=rng.randrange(1, 80))) for _ in range(200)] + [None, "", "Größe und WORD3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    folder = f"file://{tmp_path}/index"
    P.written(docs, "id", "text", folder, buckets=16)
    for q in ("word3 word50", "größe word59 absent", "word0"):
        want = [(r["id"], round(r["score"], 9)) for r in R.bm25(docs, "id", "text", q, 20).collect()]
        assert [(r["id"], round(r["score"], 9)) for r in P.bm25(spark, folder, "id", q, 20).collect()] == want
    assert P.bm25(spark, folder, "id", "the of", 5).count() == 0 and P.bm25(spark, folder, "id", "absent", 5).count() == 0
    found = P.hits(spark, folder, ["word3"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "In(term" in plan or "EqualTo(term" in plan
    P.written(docs.limit(0), "id", "text", folder + "-none")
    assert P.bm25(spark, folder + "-none", "id", "word3", 5).count() == 0


def test_memory_gate(spark):
    f = spark.createDataFrame
    memories = f([(1, "the parser fails on PDF tables in the second page of every report", "fact", 2), (2, "short one", "fact", 1), (3, "parser of tables again, pdf", "insight", 1)], "memory_id int, content string, memory_type string, evidence int")
    sources = f([(1, "s1"), (2, "s2"), (3, "s1")], "memory_id int, session_id string")
    occ = f([("e1", "s1"), ("e1", "s1"), ("e2", "s2"), ("e3", "s9")], "entity_id string, session_id string")
    ent = f([("e1", "Parser", True), ("e2", "Lexer", True), ("e3", "Gone", True), ("e4", "Raw", False)], "entity_id string, canonical_name string, promoted boolean")
    rows = [(1, "parser", "", "PDF tables"), (2, "PARSER", "insight", "pdf a"), (3, "lexer", "fact", "missing"), (4, "", "", "pdf"), (5, "parser", None, "parser")]
    expected = f(rows, "expected_id int, entity_name string, memory_type string, content_hint string")
    got = {r["expected_id"]: r["memory_id"] for r in Q.matched(memories, sources, occ, ent, expected).collect()}
    assert got == {1: 1, 2: 3, 5: 1}
    labels = f([("correct",), ("partial",), ("incorrect",), ("correct",), ("correct",), ("correct",)], "label string")
    one = Q.gate(memories, sources, occ, ent, expected, labels).first().asDict()
    assert one == {"total": 3, "cross_session": 1, "trivial": 2, "coverage": 2 / 3, "recall": 2 / 5, "false_rate": 1 / 5, "passes": False}
    one = Q.gate(memories, sources, occ, ent, expected.where("expected_id = 1"), labels).first()
    assert one["recall"] == 1.0 and one["passes"]
    one = Q.gate(memories, sources, occ, ent, expected, labels.limit(0)).first()
    assert one["false_rate"] == 1 / 3
    one = Q.gate(memories.limit(0), sources, occ, ent, expected.limit(0), labels.limit(0)).first()
    assert (one["total"], one["coverage"], one["recall"], one["false_rate"], one["passes"]) == (0, 0.0, 0.0, 1.0, False)


def test_spaced(spark):
    rows = spark.createDataFrame([("s", i, float(100 - i)) for i in range(20)], "s string, at long, v double")
    assert sorted(r["at"] for r in TR.spaced(rows, "s", "at", ["-v"]).collect()) == [0, 7]


def test_expanding_z_matches_running_stats(spark):
    xs = [3.0, 3.0, 5.0, 1.0, 1.0]
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "s string, i int, x double")
    got = [r[0] for r in rows.orderBy("i").select(TR.expanding_z(F.col("x"), "s", ["i"])).collect()]
    for i, z in enumerate(got):
        seen = xs[: i + 1]
        sd = np.std(seen, ddof=1) if i else 1.0
        assert z == pytest.approx((xs[i] - np.mean(seen)) / sd if sd else 0.0)


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(V.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_jsonl_parsing(spark, tmp_path):
    folder = tmp_path / "projects" / "p1"
    folder.mkdir(parents=True)
    lines = [
        {"type": "user", "sessionId": "s1", "cwd": "/w", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "please fix the bug"}},
        {"type": "assistant", "timestamp": "2026-01-01T00:00:05Z", "message": {"model": "m", "usage": {"input_tokens": 7, "output_tokens": 3}, "content": [{"type": "tool_use", "id": "u1", "name": "Bash", "input": {"command": "git show abcdef1 /a/b.py"}}]}},
        {"type": "user", "toolUseResult": {"x": 1}, "message": {"content": [{"type": "tool_result", "tool_use_id": "u1", "content": "fatal", "is_error": True}]}},
        {"type": "progress"},
        {"type": "user", "message": {"content": [{"type": "text", "text": "now the other one"}]}},
    ]
    (folder / "a.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken", ""]))
    m = H.jsonl_messages(spark, str(tmp_path))
    assert m.count() == 5
    d = sorted(H.descriptors(H.jsonl_exchanges(m)).collect(), key=lambda r: r["exchange"])
    assert [(r["user_word_count"], r["model_turn_count"]) for r in d] == [(4, 1), (4, 0)]
    assert d[0]["tool_calls"][0]["target"] == "git" and d[0]["tool_errors"] == [True]
    a = H.session_attributes(m).first()
    assert (a["session_id"], a["cwd"]) == ("s1", "/w")
    meta = H.session_metadata(m).first()
    assert (meta["input_tokens"], meta["duration_ms"], meta["tool_calls"]) == (7, 5000, 1)
    assert "fatal" in H.evidence(H.jsonl_exchanges(m)).first()["evidence"]
    found = H.discovered(spark, str(tmp_path), "*.jsonl", "claude_code")
    assert found.first()["project"] == "projects"


def test_chat_parsing(spark, tmp_path):
    (tmp_path / "session-1.json").write_text(json.dumps({"sessionId": "g", "messages": [{"id": "1", "type": "user", "content": "hi"}, {"id": "2", "type": "gemini", "content": "yes"}]}))
    (tmp_path / "session-2.jsonl").write_text("\n".join([json.dumps({"sessionId": "h", "kind": "main"}), json.dumps({"id": "1", "type": "user", "content": "x"}), json.dumps({"$set": {"a": 1}})]))
    got = sorted((r["session_id"], r["type"]) for r in H.chat_messages(spark, str(tmp_path)).collect())
    assert got == [("g", "gemini"), ("g", "user"), ("h", "user")]


def test_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, TB.upserted(a, b, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, TB.inserted(a, b, ["k"]).collect())) == [(1, "x"), (2, "y"), (3, "w")]
    for name in TB.SCHEMAS:
        assert TB.empty(spark, name).count() == 0


def test_seams(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id int, t string")
    got = {r["id"]: r["embedding"] for r in S.embedded(df, "t").collect()}
    assert got[1] == got[2] and len(got[3]) == 64
    many = spark.createDataFrame([("s", i, f"part {i}. more") for i in range(23)], "s string, i int, t string")
    assert S.summarized(many, "s", "t", "i").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, i, float(i)) for i in range(50)], "k int, at int, v double")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = INC.file_stream(spark, f"{tmp_path}/in", "k int, at int, v double", per_batch=1)
    INC.drained(stream, lambda b, i: b.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50


def test_workspace_and_text(spark):
    df = spark.createDataFrame([("-Users-me-src-app",), ("/home/x/app",), ("app",), ("",)], "w string")
    assert [r[0] for r in df.select(T.format_workspace(F.col("w"))).collect()] == ["app", "app", "app", ""]
    t = spark.createDataFrame([("works correctly I think it is so",), ("too short",), ("a memory of more than six words here",)], "c string")
    assert [r[0] for r in t.select(T.trivial_memory(F.col("c"))).collect()] == [True, True, False]


def test_walks_cover_all_sessions(spark):
    from sessionlens.plans import search

    occ = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (13, 8)], "session_id long, entity_id long")
    sources = spark.createDataFrame([(100, 1), (200, 2), (300, 13)], "memory_id long, session_id long")
    memories = spark.createDataFrame([(100, 3, 0), (200, 2, 0), (300, 1, 0)], "memory_id long, evidence long, access long")
    assert {r["memory_id"] for r in search.r8(occ, sources, memories).collect()} >= {200, 300}
    assert {r["memory_id"] for r in search.r9(occ, sources, memories).collect()} >= {100, 200, 300}
