"""Failure keywords in chunk texts, by harness, and in thoughts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords, in the order in which the alternation tries them.
USER = [
    "not working", "still not", "still broken", "still cannot", "still failing", "broken", "cannot", "can't", "doesn't work",
    "not loading", "not moving", "not responding", "not updating", "not found", "again", "that's wrong", "that's not", "you're not",
    "keeps happening", "same problem", "same issue",
]
AGENT = [
    "i apologize", "i was wrong", "i made an error", "let me try", "try again", "try a different", "different approach",
    "let me reconsider", "unexpected", "i'm not sure", "i notice i've been", "i notice the", "this is strange", "this isn't working",
    "seems incorrect", "i misunderstood", "let me re-read", "my previous", "i see the issue", "the issue is",
]
NOUNS = [
    "bug", "error", "exception", "traceback", "failed", "failure", "incorrect", "wrong", "issue", "problem", "crash", "fix",
]
HARNESS = {
    "claude_code": [
        "exit code", "inputvalidationerror", "tool_use_error", "permission denied", "no such file", "command not found", "syntax error",
    ],
    "gemini_cli": [
        "compilation error", "type error", "cannot find module", "build failed", "npm error",
    ],
    "opencode": [
        "status: error", "exit_code", "stderr:", "command failed",
    ],
}
THOUGHT = [
    "misstep", "incorrect", "reconsider", "reconsidering", "backtrack", "error", "failed", "problem", "issue", "I was wrong", "redo",
    "retry", "re-approach", "revisit",
]


def pattern(words: list[str]) -> str:
    return "(?i)" + "|".join(map(re.escape, words))


def _count(text: Column, words: list[str]) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern(words))), F.lit(0))


def density(text: Column, plugin: Column) -> Column:
    """Keywords that any harness shares, and the plugin's own."""
    own = F.lit(0)
    for name, words in HARNESS.items():
        own = F.when(plugin == name, _count(text, words)).otherwise(own)
    return _count(text, USER + AGENT + NOUNS) + own


def thought_density(thoughts: Column) -> Column:
    """Over an array of (subject, description)."""
    each = F.transform(thoughts, lambda t: _count(t["subject"], THOUGHT) + _count(t["description"], THOUGHT))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)
