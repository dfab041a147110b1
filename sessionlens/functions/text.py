"""Text functions: tokens, query terms, words, token estimates, truncation, stemming."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Index tokens: lower-case ASCII letters and digits, and every character beyond ASCII.
TOKEN = r"[a-z0-9\u0080-￿]+"

# Words without topical signal, dropped from queries.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did "
    "will would could should may might what how when where who which why i we you he ai ml she they it my our your "
    "his her their its this that these those not no nor so yet both either neither than then there here about above "
    "after before between into through during while as if because since although though me him us them"
).split()

# Phrases that mark a memory as trivial.
TRIVIAL = [
    "works correctly", "works.", "works!", "was created successfully", "is correct", "completed successfully",
    "succeeded", "the file", "the directory", "the working directory",
]
TRIVIAL_WORDS = 6


def query_terms(query: str, ascii_only: bool = False) -> list[str]:
    """Distinct terms of a query: lower-cased, stop words and terms of one or two letters dropped, in order."""
    found = re.findall(r"[a-z0-9]+" if ascii_only else "[a-z0-9\u0080-￿]+", query.lower())
    return list(dict.fromkeys(t for t in found if t not in set(STOP_WORDS) and len(t) > 2))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    """Words between blanks; 0 for null and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def token_estimate(text: Column) -> Column:
    """max(1, 1.3 tokens a word), cut to a whole number."""
    return F.greatest(F.lit(1), F.floor(word_count(text) * F.lit(1.3))).cast("long")


def clipped(text: Column, n: int, mark: str = "…") -> Column:
    """The text, or its first n characters and a mark."""
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def short_theme(text: Column, n: int = 60) -> Column:
    """At most n characters, cut at the last blank if that leaves at least 60 %; then a mark."""
    head = F.left(text, F.lit(n))
    word = F.regexp_extract(head, r"(?s)^(.*)\s\S*$", 1)
    cut = F.when(F.char_length(word) >= int(n * 0.6), word).otherwise(head)
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def like_literal(text: Column, part: str) -> Column:
    """Case-insensitive containment."""
    return F.contains(ascii_lower(text), F.lit(part.lower()))


def trivial_memory(content: Column) -> Column:
    low = F.lower(F.trim(content))
    phrase = F.lit(False)
    for p in TRIVIAL:
        phrase = phrase | F.contains(low, F.lit(p))
    return (word_count(low) < TRIVIAL_WORDS) | phrase


def format_workspace(ws: Column) -> Column:
    """A project's name from a path or an encoded path, so that the same project meets itself across harnesses."""
    base = F.element_at(F.split(ws, "/"), -1)
    out = F.regexp_replace(ws, r"^-(?:Users|home)-[^-]+-", "")
    out = F.regexp_replace(out, r"(?i)^-?(?:src|Documents|projects|home|desktop)-", "")
    out = F.regexp_replace(out, "^-+", "")
    return F.when(F.coalesce(ws, F.lit("")) == "", F.lit("")).when(F.contains(ws, F.lit("/")), base).when(out == "", ws).otherwise(out)


def _stem(word: str) -> str:
    """Porter's stemmer, from the 1980 paper's rules."""
    if len(word) <= 2 or not word.isascii():
        return word
    w = word

    def form(s: str) -> str:
        out = ""
        for i, c in enumerate(s):
            vowel = c in "aeiou" or (c == "y" and i > 0 and out[i - 1] == "c")
            out += "v" if vowel else "c"
        return out

    def measure(s: str) -> int:
        return len(re.findall("v+c+", form(s)))

    def cvc(s: str) -> bool:
        return len(s) >= 3 and form(s)[-3:] == "cvc" and s[-1] not in "wxy"

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and "v" in form(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and "v" in form(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and form(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and "v" in form(w[:-1]):
        w = w[:-1] + "i"
    # The paper's steps 2, 3 and 4
    two = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
    three = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
    for step in (two, three):
        for rule in sorted(step.split(), key=lambda r: -len(r.split(":")[0])):
            end, new = rule.split(":")
            if w.endswith(end):
                if measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


def stemmed(term: Column) -> Column:
    """Porter stems, in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map({t: _stem(t) for t in s.dropna().unique()})

    return run(term)
