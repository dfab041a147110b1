"""Personal data with offset-preserving deobfuscation.

Base spans are the four exact patterns over each whole text. Then transducers rewrite the text (homoglyphs and
compatibility forms letter by letter, zero-width characters to nothing, runs of spelled digits to digits, at/dot
disguises to @ and .) and keep, for every piece of the rewritten text, where it came from; the same patterns run
over the rewritten text, and spans that are not part of a base span of their kind are mapped back to source
characters and added beside the base ones.

Defined results: a null text is empty and has no spans; repeated rows are treated one by one; an empty table
gives an empty result; other columns are ignored; a null doc_id is kept. All patterns take linear time, so very
long texts are safe.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.common import in_slices, table

KINDS = ["email", "ip", "card", "phone"]

# The contract's patterns. Possessive runs and look-behinds drop only starts inside a run, which can't match
# when the run's own start doesn't.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind's index, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        floor = at + 1  # nothing before this @ can be the local part of a later one
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    """All spans of the contract's patterns, by start, then kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = [x.lstrip("0") for x in m[0].split(".")]
        if all(len(x) < 4 and int(x or 0) <= 255 for x in parts):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NON_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# Cyrillic and Greek letters that look like Latin ones, each pair as "look-alike Latin".
_LOOKALIKES = """
а a  е e  о o  р p  с c  у y  х x  і i  ј j  ѕ s  ԁ d  һ h  ԛ q  ԝ w  ӏ l
А A  В B  Е E  К K  М M  Н H  О O  Р P  С C  Т T  Х X  І I  Ј J  Ѕ S
α a  ο o  ν v  ρ p  ι i  κ k
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X
"""
# Zero-width characters, which the transducer deletes.
_ZERO_WIDTH = "­​‌‍⁠﻿"
# Spelled digits.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


@lru_cache(maxsize=1)
def _letters() -> dict[int, str]:
    """Homoglyphs: look-alikes, and every character below U+20000 whose compatibility form is one plain ASCII sign."""
    pairs = _LOOKALIKES.split()
    out = {ord(a): b for a, b in zip(pairs[::2], pairs[1::2], strict=True)}
    for c in [*range(0x2070, 0x2190), *range(0x2460, 0x2500), *range(0xFE50, 0xFFEF), *range(0x1D400, 0x1D800)]:
        n = unicodedata.normalize("NFKC", chr(c))
        if len(n) == 1 and re.match(r"[A-Za-z0-9@.+()-]", n):
            out[c] = n
    for c in range(0x660, 0x20000):  # decimal digits of other scripts
        if chr(c).isdecimal():
            out[c] = str(unicodedata.decimal(chr(c)))
    out |= {c: "-" for c in range(0x2010, 0x2016)} | {0xA0: " ", 0x202F: " "}
    return out


@lru_cache(maxsize=1)
def _odd() -> frozenset[str]:
    return frozenset(map(chr, _letters())) | frozenset(_ZERO_WIDTH)


#: Holds all of _odd and is quick to look for; texts in Latin letters have none of it.
_MAYBE_ODD = re.compile("[\xa0\xad\u0250-\U0010ffff]")


# Marks of disguised addresses: at and dot in brackets, as bare words between blanks, or plain. A mark takes all
# blanks around it; it begins where its blanks begin, so that a long run of blanks is read once.
_MARK = re.compile(r"(?:(?<!\s)\s++|(?<!\s))[\[({<]\s*+(?:at|@|dot|\.)\s*+[\])}>]\s*+|(?<!\s)\s++(?:at|dot)\s++|[@.]", re.I)
_PLAIN, _BARE, _BRACKET = range(3)
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_DOT = r"(?:\s*+[\[({<]\s*+(?:dot|\.)\s*+[\])}>]\s*+|\s++dot\s++|\.)"
_DOT_PART = re.compile(_DOT, re.I)
_DOT_MARK = re.compile(r"[\[({<]\s*+(?:dot|\.)\s*+[\])}>]|\sdot\s", re.I)
_BRACKETED = re.compile(r"[\[({<]\s*+(?:at|@|dot|\.)\s*+[\])}>]", re.I)
# Words that tell prose ("we met at the dot and left") from an address spelled with bare words only:
# the first label is no determiner and the last no function word.
_DETERMINERS = frozenset("a an the this that these those each every any some my your his her its our their one".split())
_FUNCTION_WORDS = frozenset("a an and are as but by for from had has have he her his if its nor not of on or she that the their then they this to was were when where which who will with you".split())
_WORD = "(?:" + "|".join(_SPELLED) + ")"
_DIGIT_WORD = f"(?:{_WORD}|[0-9])"
_TOKEN = f"(?:{_WORD}|[0-9]++)"
_BETWEEN = "[ ,().-]++"
#: Spelled digits and groups of digits side by side; one is a word at least (checked where it is used).
_SPELLED_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:(?:plus|\+)[ ,(-]*+)?{_TOKEN}(?:{_BETWEEN}{_TOKEN})+(?![A-Za-z0-9])", re.I)
_ONE_TOKEN = re.compile(rf"plus|\+|{_TOKEN}", re.I)
_ONE_DIGIT = re.compile(rf"plus|\+|{_DIGIT_WORD}", re.I)
_LONE_WORD = re.compile(rf"(?<![a-z0-9]){_WORD}(?![a-z0-9])")
_PART = rf"(?:[0-9]++|{_WORD}(?:[ -]{_WORD}){{0,2}})"
#: Four numbers with dots between them, of which a dot or a number is disguised.
_DOTTED = re.compile(rf"(?<![A-Za-z0-9.]){_PART}(?:{_DOT}{_PART}){{3}}(?![A-Za-z0-9])(?!\.[0-9])", re.I)


class Rewritten:
    """A text made of pieces; `source` maps a span of it back to the characters it was made from."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.starts: list[int] = []
        self.sources: list[tuple[int, int, bool]] = []
        self.size = 0

    def add(self, piece: str, start: int, end: int, exact: bool) -> None:
        """exact: piece's characters are the source's one for one."""
        if piece:
            self.parts.append(piece)
            self.starts.append(self.size)
            self.sources.append((start, end, exact))
            self.size += len(piece)

    def source(self, start: int, end: int) -> tuple[int, int]:
        a, b = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (s, _, exact), (t, e, exact_end) = self.sources[a], self.sources[b]
        return s + (start - self.starts[a] if exact else 0), t + (end - self.starts[b]) if exact_end else e


def _digits(text: str) -> str:
    return "".join("+" if (x := d[0].lower()) in ("plus", "+") else _SPELLED.get(x, x) for d in _ONE_DIGIT.finditer(text))


def _by_kind(spans: list[Span]) -> list[tuple[list[int], list[int]]]:
    """Starts and ends of the spans of each kind, in order; those of one kind don't overlap."""
    by: dict[int, tuple[list[int], list[int]]] = {}
    for s, kind, e in sorted(spans):
        starts, ends = by.setdefault(kind, ([], []))
        starts.append(s)
        ends.append(e)
    return list(by.values())


def _inside(by_kind: list[tuple[list[int], list[int]]], start: int, end: int) -> bool:
    """Does a span hold start to end?"""
    return any((k := bisect_right(starts, start)) and end <= ends[k - 1] for starts, ends in by_kind)


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, new) of the runs of spelled digits, plain digits among them.

    Dots stay between digits but for numbers with a plus, other separators go; a comma joins single digits only.
    A lone word beside an identifier that is complete in plain digits is prose ("10.0.0.1 two hosts").
    """
    plain = None
    for m in _SPELLED_RUN.finditer(text):
        if not m[0].isascii():
            continue
        runs: list[list[re.Match]] = [[]]
        for x in _ONE_TOKEN.finditer(text, m.start(), m.end()):
            before = runs[-1][-1] if runs[-1] else None
            if before and "," in text[before.end() : x.start()] and any(len(t[0]) > 1 and t[0].isdigit() for t in (before, x)):
                runs.append([])
            runs[-1].append(x)
        for tokens in runs:
            word = [x[0].lower() in _SPELLED for x in tokens]
            for edge, beside in ((-1, -2), (0, 1)):
                if len(tokens) > 1 and word[edge] and tokens[beside][0].isdigit():
                    plain = _by_kind(base_spans(text)) if plain is None else plain
                    if _inside(plain, *tokens[beside].span()):
                        del tokens[edge], word[edge]
            if len(tokens) < 2 or not any(word):
                continue
            dot = "" if tokens[0][0].lower() in ("plus", "+") else "."
            new = [_digits(tokens[0][0])]
            for x, y in zip(tokens, tokens[1:], strict=False):
                new += [dot if "." in text[x.end() : y.start()] else "", _digits(y[0])]
            yield tokens[0].start(), tokens[-1].end(), "".join(new)


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, new) of the marks of disguised addresses.

    An address is a mark for @ with labels and marks for dots on both sides, of any number and any distance of
    blanks. Every mark is looked at once from its left and once from its right.
    """
    marks = []
    for m in _MARK.finditer(text):
        inner = m[0].strip()
        word = inner.strip("[](){}<>").strip().lower() if len(inner) > 1 else inner
        marks.append((m.start(), m.end(), word in ("at", "@"), _PLAIN if len(inner) == 1 else _BRACKET if inner[0] in "[({<" else _BARE))
    for i, (start, end, is_at, style) in enumerate(marks):
        if not is_at or not (label := _LABEL.match(text, end)):
            continue
        first, after, j = label[0], [], i + 1
        while j < len(marks) and marks[j][0] == label.end() and not marks[j][2] and (more := _LABEL.match(text, marks[j][1])):
            after.append(marks[j])
            label, j = more, j + 1
        if not after:
            continue
        before, k, s = [], i - 1, start
        while True:
            low, e = (marks[k][1] if k >= 0 else 0), s
            while s > low and text[s - 1] in _NAME:
                s -= 1
            if s == e:
                break  # no label here
            if e < start:
                before.append(marks[k + 1])
            if s > low or k < 0 or marks[k][2]:
                break
            s, k = marks[k][0], k - 1
        if s == start:
            continue
        dots = max(x[3] for x in after)
        if max(style, dots, *(x[3] for x in before), _PLAIN) == _PLAIN:
            continue  # a plain address
        if style == _BARE:
            if dots == _PLAIN:
                continue  # "look at example.com" is prose
            if dots == _BARE and (first.lower() in _DETERMINERS or label[0].lower() in _FUNCTION_WORDS):
                continue
        yield from ((x[0], x[1], ".") for x in before)
        yield start, end, "@"
        yield from ((x[0], x[1], ".") for x in after)


def _rewrites(text: str) -> list[tuple[int, int, str]]:
    """(start, end, new) of the pieces to replace, in order; some may overlap, the first then counts."""
    out = []
    low = text.lower()
    if "dot" in low or _BRACKETED.search(text):
        out += _addresses(text)
        for m in _DOTTED.finditer(text):
            if _DOT_MARK.search(m[0]):
                at, new = 0, []
                for x in _DOT_PART.finditer(m[0]):
                    new.append(_digits(m[0][at : x.start()]))
                    at = x.end()
                out.append((m.start(), m.end(), ".".join([*new, _digits(m[0][at:])])))
    if _LONE_WORD.search(low):
        # what at and dot stand between is theirs
        out.sort()
        starts, ends = [s for s, _, _ in out], [e for _, e, _ in out]
        for s, e, new in _spelled(text):
            if bisect_right(ends, s) == bisect_right(starts, e - 1):
                out.append((s, e, new))
    out.sort()
    return out


def deobfuscated(text: str) -> tuple[str, list] | None:
    """The rewritten text and a chain of mappers back to source spans; None where nothing is disguised."""
    maps = []
    now = text
    if not text.isascii() and _MAYBE_ODD.search(text) and not _odd().isdisjoint(text):
        now = text.translate(_letters())
        if any(c in now for c in _ZERO_WIDTH):
            r, at = Rewritten(), 0
            for m in re.finditer(f"[{_ZERO_WIDTH}]+", now):
                r.add(now[at : m.start()], at, m.start(), True)
                at = m.end()
            r.add(now[at:], at, len(now), True)
            maps.append(r)
            now = "".join(r.parts)
    if pieces := _rewrites(now):
        r, at = Rewritten(), 0
        for s, e, new in pieces:
            if s < at:
                continue
            r.add(now[at:s], at, s, True)
            r.add(new, s, e, False)
            at = e
        r.add(now[at:], at, len(now), True)
        maps.append(r)
        now = "".join(r.parts)
    return None if now == text else (now, maps)


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of disguised identifiers, in source characters, but for those equal to or inside a base span of their kind."""
    made = deobfuscated(text)
    if made is None:
        return []
    now, maps = made
    taken = [[(s, e) for s, kind, e in base if kind == k] for k in range(len(KINDS))]
    out = []
    for s, k, e in base_spans(now):
        for r in reversed(maps):
            s, e = r.source(s, e)
        i = bisect_right(taken[k], s, key=lambda x: x[0]) - 1  # spans of one kind don't overlap
        if i < 0 or taken[k][i][1] < e:
            out.append((s, k, e))
    return sorted(set(out))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    more = added_spans(text, base)
    return base, sorted(base + more) if more else base


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first wins, grown."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_<kind> and base_sha256 of the base spans, spans (all, as text) and n_added."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = [f"n_{k}" for k in KINDS]
    schema = f"k {rows.schema['k'].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in counts)}, base_sha256 string, spans string, n_added bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            n, sha, spans, added = [[] for _ in KINDS], [], [], []
            for t in b.column("text").to_pylist():
                base, every = scan(t)
                for k, x in enumerate(n):
                    x.append(sum(s[1] == k for s in base))
                sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                added.append(len(every) - len(base))
            cols = [b.column("k"), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["k", *counts, "base_sha256", "spans", "n_added"])

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of `text` replaced by its kind; n_chars, where there is one, follows. Null stays null."""
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            at = b.schema.get_field_index(text)
            new = [None if t is None else redact(t, s) if (s := scan(t)[1]) else t for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType)).select(cols) if "n_chars" in cols else out


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every span found becomes its kind in brackets; all documents and columns stay."""
    return redacted(docs)
