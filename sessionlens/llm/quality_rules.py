"""Quality rules as a learned decision list.

Base statistics of each whole text are computed in Arrow batches (bytes and word hashes in NumPy), a list of
threshold conjunctions is grown and pruned by sequential covering on labelled statistics, and the list is
applied as ordered Spark conditional expressions.

Defined results: a null text has no words (all counts 0, base_failed); an empty table gives an empty result;
repeated rows are judged one by one; other columns are ignored; a null doc_id is kept as it is. Without usable
labels the list is empty and only the base rules reject.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.common import in_slices, table

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = ["n_upper", "n_lower", "n_digit", "n_bang", "n_lines", "n_alpha_words", "n_bytes", "n_distinct"]
FEATURES = ["word_len", "symbols", "dup_lines", "repeats", "upper", "digits", "bangs", "alpha_words", "variety", "words"]
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIX = np.uint64(0x9E3779B97F4A7C15)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_LOOK = {
    "n_symbols": _table(SYMBOLS),
    "n_upper": _table(bytes(range(65, 91))),
    "n_lower": _table(bytes(range(97, 123))),
    "n_digit": _table(bytes(range(48, 58))),
    "n_bang": _table(b"!"),
    "n_lines": _table(b"\n"),
}
_BLANK = _table(b" \t\n\x0b\x0c\r")
_LEAD = np.array([0 if 0x80 <= b < 0xC0 else 1 for b in range(256)], dtype=np.int64)


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in a 5-word window that occurs twice or more in the text."""
    if len(words) <= WINDOW:
        return 0
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - WINDOW + 1
    w = h[:n].copy()
    for k in range(1, WINDOW):
        w = (w ^ (w >> np.uint64(29))) * MIX + h[k : k + n]
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, dtype=np.int32)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def text_counts(text: bytes) -> dict[str, int]:
    """All counts of one text; the counts behind BASE are exact for any length."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    by = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    return {
        "n_words": len(words),
        "word_chars": int(by @ _LEAD - by @ _BLANK),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
        "n_alpha_words": sum(map(bytes.isalpha, words)),
        "n_distinct": len(set(words)),
        "n_bytes": len(text),
    } | {k: int(by @ v) for k, v in _LOOK.items()}


def counted(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all by default, as they are) and BASE and COUNTS of each row's text."""
    keep = docs.columns if keep is None else keep
    names = BASE + COUNTS
    packed = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            rows = [text_counts(x) for x in b.column("text").cast(pa.binary()).to_pylist()]
            cols = [pa.array([r[c] for r in rows], type=pa.int64()) for c in names]
            yield pa.RecordBatch.from_arrays([b.column("row"), *cols], names=["row", *names])

    return packed.mapInArrow(run, schema)


def features() -> dict[str, Column]:
    """The features of the rules, from BASE and COUNTS."""
    words, size = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_bytes"), F.lit(1))
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    made = {
        "word_len": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / (F.col("n_lines") + 1),
        "repeats": F.col("n_repeat_words") / words,
        "upper": F.col("n_upper") / letters,
        "digits": F.col("n_digit") / size,
        "bangs": F.col("n_bang") / words,
        "alpha_words": F.col("n_alpha_words") / words,
        "variety": F.col("n_distinct") / words,
        "words": F.col("n_words").cast("double"),
    }
    return {k: made[k].cast("double").alias(k) for k in FEATURES}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


@dataclass
class Rule:
    """A conjunction of (feature, '>' or '<=', threshold) that rejects."""

    terms: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), dtype=bool)
        for f, op, t in self.terms:
            v = x[:, FEATURES.index(f)]
            hit &= (v > t) if op == ">" else (v <= t)
        return hit

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.terms:
            out = out & ((F.col(f) > t) if op == ">" else (F.col(f) <= t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.terms) or "true"


@dataclass
class DecisionList:
    """Ordered rules that reject; what no rule covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def kept(self) -> Column:
        """The list as one ordered CASE expression over FEATURES."""
        out = None
        for r in self.rules:
            out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _best_term(x: np.ndarray, bad: np.ndarray, rule: Rule, cuts: int) -> tuple[float, tuple[str, str, float] | None]:
    """The term with the greatest information gain (FOIL) over what the rule covers.

    Of its feature's cuts that gain nearly as much (95 %) the one that covers least is taken: it lies within the
    bad rows rather than next to the good ones.
    """
    hit = rule.covers(x)
    p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
    if not p0 or not n0:
        return 0.0, None
    base, best, term, cuts_of = np.log2(p0 / (p0 + n0)), 0.0, None, {}
    for i, f in enumerate(FEATURES):
        v = x[hit, i]
        b = bad[hit]
        for t in np.unique(np.quantile(np.unique(v), np.linspace(0, 1, cuts + 2)[:-1])):
            above = v > t
            if above.any():  # half-way to the next value, so that a cut keeps its distance from both sides
                t = (t + v[above].min()) / 2
            p, n = (above & b).sum(), (above & ~b).sum()
            for op, pp, nn in ((">", p, n), ("<=", p0 - p, n0 - n)):
                if pp:
                    gain = pp * (np.log2(pp / (pp + nn)) - base)
                    cuts_of.setdefault((f, op), []).append((gain, float(t)))
                    if gain > best:
                        best, term = gain, (f, op, float(t))
    if term:
        near = [t for gain, t in cuts_of[term[:2]] if gain >= 0.95 * best]
        term = (*term[:2], max(near) if term[1] == ">" else min(near))
    return best, term


def learn(
    x: np.ndarray, bad: np.ndarray, precision: float = 0.97, least: int = 5, most_terms: int = 4, cuts: int = 64, seed: int = 7
) -> DecisionList:
    """Sequential covering: grow a conjunction on two thirds of the rows, prune it on the rest, keep it while
    its precision on both parts is at least `precision`, remove what it covers, and go on.

    x: rows of FEATURES; bad: True where a row should go. Too few bad rows give an empty list.
    """
    out, left = DecisionList(), np.ones(len(x), dtype=bool)
    grow = np.random.default_rng(seed).random(len(x)) < 2 / 3
    for _ in range(32):
        g, p = left & grow, left & ~grow
        if (bad & g).sum() < least:
            break
        rule = Rule()
        while len(rule.terms) < most_terms:
            _, term = _best_term(x[g], bad[g], rule, cuts)
            if term is None:
                break
            rule.terms.append(term)

        def worth(r: Rule, part: np.ndarray = p) -> float:
            hit = r.covers(x[part])
            pos, neg = (hit & bad[part]).sum(), (hit & ~bad[part]).sum()
            return (pos - neg * precision / (1 - precision)) if pos + neg else -1.0

        kept, best = rule, worth(rule)
        while len(kept.terms) > 1:  # prune: drop the term whose loss does the pruning rows most good
            score, shorter = max(((worth(Rule(kept.terms[:i] + kept.terms[i + 1 :])), i) for i in range(len(kept.terms))))
            if score < best:
                break
            best, kept = score, Rule(kept.terms[:shorter] + kept.terms[shorter + 1 :])
        hit = kept.covers(x) & left
        if not kept.terms or (bad & hit).sum() < least or (bad & hit).sum() < precision * hit.sum() or best < 0:
            break
        out.rules.append(kept)
        left &= ~hit
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20000, precision: float = 0.97) -> DecisionList:
    """Learn from at most `sample` labelled documents, those of the least hash of doc_id. quality 0 is bad.

    Rows with a null doc_id or quality are left out; several labels of a document count as its lowest, and of several
    rows with one doc_id the one whose text has the least digest counts.
    """
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers, whatever the size of the tables
    found = docs.join(F.broadcast(lab), "doc_id").select("doc_id", "quality", "text", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"))
    rows = counted(found, keep=["doc_id", "quality", "digest"]).select("row.*", base_failed().alias("failed"), *features().values())
    one = rows.groupBy("doc_id").agg(F.min(F.struct("digest", "failed", "quality", *FEATURES)).alias("one")).select("one.*")
    got = one.where("not failed").select("quality", *FEATURES).toPandas()
    got = got.sort_values([*FEATURES, "quality"])
    return learn(got[FEATURES].to_numpy(dtype=float).reshape(-1, len(FEATURES)), (got["quality"] == 0).to_numpy(dtype=bool), precision)


def judged(docs: DataFrame, rules: DecisionList, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of `keep`), BASE, base_failed and kept of each row."""
    rows = counted(docs, keep=keep).withColumn("base_failed", base_failed())
    rows = rows.select("row", *BASE, "base_failed", *features().values())
    return rows.select("row", *BASE, "base_failed", (~F.col("base_failed") & rules.kept()).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judged(docs, rules, keep=["doc_id"]).select("row.doc_id", *BASE, "base_failed", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the base rules or the learned list reject go; columns stay."""
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judged(docs, rules).where("kept").select("row.*")
