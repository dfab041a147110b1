"""Substring dedup by paragraphs: MinHash bands, exact Jaccard, removals by components.

A paragraph is a line with at least `min_words` words, or a run of shorter lines that together have them. Equal
shingle sets are one class; classes whose signatures collide in a band are confirmed by exact Jaccard on their 5-word shingles, and of every component of classes the
first occurrence (least doc_id, then position) stays and all others go. Bands are tuned for the threshold.

Paragraphs follow the line layout; passages that repeat inside longer lines or across lines are added beside them.

Defined results: null and empty texts have no paragraphs; shorter lines whose run is below min_words are never removed; a document's
own repeats count like others'; rows with one doc_id count as one document (equal positions are one paragraph);
rows with a null doc_id are left out of dedup and get a row with no removals; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.common import in_slices, joined, stored, table
from sessionlens.llm.near import band_keys, class_components, min_hash, set_digest, shingle_sets, tuned
from sessionlens.llm.passages import with_passages

PERCENT = 80
MIN_WORDS = 20
COMPONENTS = 128


def paragraphs_of(text: str, min_words: int) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, lower-case words) of each paragraph; positions in characters."""
    out, at = [], 0
    first, run = 0, []  # the run of shorter lines before this one

    def close(end: int) -> None:
        if len(run) >= min_words:
            out.append((first, end, list(run)))
        run.clear()

    for line in text.split("\n"):
        words = line.encode().lower().split()
        if len(words) >= min_words:
            close(at - 1)
            out.append((at, at + len(line), words))
        elif words:
            if not run:
                first = at
            run += words
        at += len(line) + 1
    close(len(text))
    return out


def units(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, start, end, n and fp of every paragraph."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, end bigint, n bigint, fp binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 1024):
            ids, start, end, units_ = [], [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for s, e, words in paragraphs_of(t, min_words):
                    ids.append(i)
                    start.append(s)
                    end.append(e)
                    units_.append(words)
            sets = shingle_sets(units_)
            n, fp = [len(x) for x in sets], [set_digest(x) for x in sets]
            cols = [pa.array(ids, b.column("doc_id").type), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "end", "n", "fp"])

    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, schema)


def _cut(docs: DataFrame, classes: DataFrame, shape: tuple[int, int, int] | None, sets: bool) -> DataFrame:
    """(fp, set, bands) of the classes, each cut from its first document; null where not asked for.

    shape: (components, bands, rows) for the bands. The starts that a document is asked for are its own
    paragraphs at most. Rows whose doc_id is shared by another text are told by the digest.
    """
    first = classes.select(F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), F.col("first_end").alias("end"), "fp")
    first = first.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "fp")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 256):
            asked, cut = [], []
            for t, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    asked.append(w["fp"])
                    cut.append(t[w["start"] : w["end"]].encode().lower().split())
            hits = [(d, s) for d, s in zip(asked, shingle_sets(cut), strict=True) if set_digest(s) == d]
            fp, found = [d for d, _ in hits], [s for _, s in hits]
            bands = None
            if shape and found:
                bands = list(band_keys(min_hash(found, shape[0]), shape[1], shape[2]))
            cols = [
                pa.array(fp, pa.binary()),
                pa.array([s.view(np.int64) for s in found] if sets else [None] * len(fp), pa.list_(pa.int64())),
                pa.array(bands if bands is not None else [None] * len(fp), pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["fp", "set", "bands"])

    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(first, "doc_id")
    return texts.mapInArrow(run, "fp binary, set array<bigint>, bands array<bigint>")


def removals(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, most: int = COMPONENTS) -> DataFrame:
    """doc_id, start, end, first_doc, first_start, removed and shared (another document has it too) of every paragraph."""
    bands, rows = tuned(percent / 100, most)
    shape = (bands * rows, bands, rows)
    every = stored(units(docs, min_words), "para-units")
    classes = every.groupBy("fp").agg(
        F.min(F.struct("doc_id", "start")).alias("first"), F.min(F.struct("doc_id", "start", "end")).alias("whole"), F.max("doc_id").alias("last_doc"), F.first("n").alias("n"), F.count("*").alias("copies")
    )
    classes = stored(classes.select("fp", "first", "last_doc", F.col("whole.end").alias("first_end"), "n", "copies"), "para-classes")

    def sets_of(wanted: DataFrame, with_bands: bool) -> DataFrame:
        cut = _cut(docs, classes.join(wanted, "fp", "left_semi"), shape if with_bands else None, True)
        return (cut if with_bands else cut.drop("bands")).dropDuplicates(["fp"])

    roots = class_components(classes, _cut(docs, classes, shape, False), sets_of, percent)
    rooted = classes.select("fp", "first", "last_doc", "copies").join(roots, F.col("fp") == F.col("node"), "left")
    rooted = rooted.select("fp", "first", "last_doc", "copies", F.coalesce("component", "fp").alias("component"), F.col("node").isNotNull().alias("near"))
    least = rooted.where("near").groupBy("component").agg(F.min("first").alias("least"), F.max("last_doc").alias("last"))
    rooted = rooted.where("near or copies > 1").join(least, "component", "left")
    rooted = rooted.select("fp", "copies", F.coalesce("least", "first").alias("least"), F.coalesce("last", "last_doc").alias("last"))
    out = joined(every.select("doc_id", "start", "end", "fp"), stored(rooted, "para-rooted"), "fp", "copies").dropDuplicates(["doc_id", "start"])
    first_doc, first_start = F.coalesce(F.col("least.doc_id"), F.col("doc_id")), F.coalesce(F.col("least.start"), F.col("start"))
    out = out.select("doc_id", "start", "end", first_doc.alias("first_doc"), first_start.alias("first_start"), F.coalesce(F.col("last") != F.col("least.doc_id"), F.lit(False)).alias("shared"))
    return out.withColumn("removed", (F.col("doc_id") != F.col("first_doc")) | (F.col("start") != F.col("first_start")))


def summary(docs: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each distinct doc_id: n_shared and n_removed (paragraphs), removed (start:end, joined), duplicate_of
    (doc_ids), n_paragraphs."""
    gone = F.col("removed")
    by = found.groupBy("doc_id").agg(
        F.count_if("shared").alias("n_shared"),
        F.count_if(gone).alias("n_removed"),
        F.sort_array(F.collect_list(F.when(gone, F.struct("start", "end")))).alias("spans"),
        F.sort_array(F.collect_set(F.when(gone, F.col("first_doc")))).alias("duplicate_of"),
        F.count("*").alias("n_paragraphs"),
    )
    ids = docs.select("doc_id").distinct()
    out = ids.join(by, "doc_id", "left")
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    empty = F.array().cast(by.schema["duplicate_of"].dataType)
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", count("n_shared"), count("n_removed"), F.coalesce(spans, F.lit("")).alias("removed"), F.coalesce("duplicate_of", empty).alias("duplicate_of"), count("n_paragraphs"))


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_shared counts what another document has too: paragraphs, passages that repeat another document's, and one
    more where others repeat a passage of this one. n_removed and n_passages are what goes; firsts stay."""
    docs = table(spark, sf_dir, "documents")
    out = with_passages(summary(docs, removals(docs)), docs)
    others = F.size(F.array_except("passage_of", F.array("doc_id"))) > 0
    passages = F.when(others, F.col("n_passages")).otherwise(F.lit(0)) + F.col("source_of").cast("long")
    out = out.withColumn("n_shared", F.col("n_shared") + passages)
    return out.select("doc_id", "n_shared", "n_removed", "removed", "n_passages", "passages", "duplicate_of", "passage_of", "n_paragraphs")
