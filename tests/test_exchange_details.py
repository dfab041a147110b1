"""Tool results and their calls against a plain loop over slots."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from sessionlens.sources import harness as H


def slots(names, results):
    """Each result goes to the first call without text."""
    calls = [[n, "", False] for n in names]
    for text, error in results:
        for c in calls:
            if c[1] == "":
                c[1], c[2] = text[:800], error
                break
    return [tuple(c) for c in calls]


def test_results_go_to_the_first_open_call(spark):
    rng = random.Random(7)
    cases = [([f"t{i}" for i in range(rng.randrange(5))], [(rng.choice(["", "", "x", "y" * 900]), rng.random() < 0.5) for _ in range(rng.randrange(7))]) for _ in range(300)]
    rows = [(i, [(n, "{}") for n in names], results) for i, (names, results) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, calls array<struct<name:string,args:string>>, results array<struct<text:string,error:boolean>>")
    got = df.select("i", H.with_results(F.col("calls"), F.col("results")).alias("x")).collect()
    assert {r["i"]: [(c["name"], c["result"], c["is_error"]) for c in r["x"]] for r in got} == {i: slots(*c) for i, c in enumerate(cases)}


def test_details_of_exchanges(spark):
    use = lambda name, **i: {"type": "tool_use", "name": name, "input": i}
    got = lambda content, **m: {"type": "tool_result", "content": content, **m}
    session = [
        {"type": "user", "message": {"content": "please fix"}},
        {"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": "h" * 500}, {"type": "text", "text": "on it"}, use("Read", file_path="/a.py"), use("Bash", command="ls")]}},
        {"type": "user", "toolUseResult": "r", "message": {"content": [got("", is_error=True), got([{"type": "text", "text": "one"}, {"type": "text", "text": "two"}])]}},
        {"type": "assistant", "message": {"content": [use("Edit", file_path="/b.py"), {"type": "text", "text": "done"}]}},
        {"type": "user", "toolUseResult": "r", "message": {"content": [got("[no list", is_error=True)]}},
        {"type": "user", "message": {"content": [{"type": "text", "text": "thanks"}]}},
        {"type": "assistant", "message": {"content": "a plain text"}},
        {"type": "user", "message": {"content": ""}},
    ]
    lines = [("p", i, json.dumps(m)) for i, m in enumerate(session)] + [("p", 90, "{broken")]
    df = spark.createDataFrame(lines, "path string, line long, value string")
    a, b, c = sorted(H.exchange_details(H.jsonl_exchanges(H.parsed(df))).collect(), key=lambda r: r["exchange"])
    assert a["user_text"] == "please fix" and a["agent_text"] == "[thinking] " + "h" * 400 + " on it done"
    assert [(t["name"], t["result"], t["is_error"]) for t in a["tool_calls"]] == [("Read", "one two", False), ("Bash", "[no list", True), ("Edit", "", False)]
    assert a["narrative"].split("\n")[0] == "USER: please fix"
    assert a["narrative"].split("\n")[2:] == ['[tool: Read({"file_path":"/a.py"})]', "  → one two", '[tool: Bash({"command":"ls"})] [ERROR]', "  → [no list", '[tool: Edit({"file_path":"/b.py"})]']
    assert (b["user_text"], b["agent_text"], b["tool_calls"], b["narrative"]) == ("thanks", "", [], "USER: thanks")
    assert (c["user_text"], c["agent_text"], c["tool_calls"], c["narrative"]) == ("", "", [], "")
    assert H.exchange_details(H.jsonl_exchanges(H.parsed(df.where("false")))).count() == 0
