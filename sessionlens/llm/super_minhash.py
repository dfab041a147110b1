"""Near-duplicate documents by SuperMinHash.

Each shingle gets a random permutation of the signature's positions, one step at a time, and in step j offers
j + random in [0, 1) to the step's position; a position keeps the least offer. As all offers of step j lie in
[j, j + 1), a document stops as soon as every position holds less than the next step. The ranks of one shingle are
correlated, which gives a lower variance than independent hashes, and most documents stop after a few steps.
Signatures are banded; links are confirmed on full shingle sets and grouped (see `near`).

Defined results: texts without words (null, empty, blanks) have an empty set and link with nothing; fewer than
five words are one shingle; repeated rows are in one group and all get a row; a null doc_id gets component null
and is kept; an empty table gives an empty result; other columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.common import in_slices, joined, stored, table
from sessionlens.llm.near import MIX, U64, band_keys, class_components, set_digest, shingle_sets, splitmix, tuned

PERCENT = 85
COMPONENTS = 120
#: Shingles handled at once; longer sets go in pieces, whose least values are the set's.
PIECE = 1 << 16


def _steps(el: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Signatures of `docs` sets given as elements and their set's number."""
    h = np.full(docs * m, np.iinfo(np.uint64).max, dtype=U64)
    perm = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(el), m)).copy()
    at = np.arange(len(el))
    for j in range(m):
        r = splitmix(el + U64((j + 1) * int(MIX) % 2**64))
        k = j + ((r & U64(0xFFFFFFFF)) % U64(m - j)).astype(np.int64)
        place = perm[at, k]
        perm[at, k] = perm[at, j]
        np.minimum.at(h, doc * m + place, (U64(j) << U64(32)) | (r >> U64(32)))
        open_ = h.reshape(docs, m).max(axis=1) >= (U64(j + 1) << U64(32))
        go = open_[doc]
        live = int(go.sum())
        if not live:
            break
        if live < 0.8 * len(el):
            el, doc, perm = el[go], doc[go], perm[go]
            at = np.arange(len(el))
    return h.reshape(docs, m)


def signatures(sets: list[np.ndarray], m: int = COMPONENTS) -> np.ndarray:
    """A row of m values for each (non-empty) set."""
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, dtype=U64)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    group: list[int] = []
    held = 0

    def flush() -> None:
        if group:
            doc = np.repeat(np.arange(len(group)), [len(sets[i]) for i in group])
            out[group] = _steps(np.concatenate([sets[i] for i in group]), doc, len(group), m)

    for i in order:
        n = len(sets[i])
        if n > PIECE:
            for at in range(0, n, PIECE):
                part = sets[i][at : at + PIECE]
                out[i] = np.minimum(out[i], _steps(part, np.zeros(len(part), dtype=np.int64), 1, m)[0])
            continue
        if held + n > PIECE:
            flush()
            group, held = [], 0
        if n:
            group.append(i)
            held += n
    flush()
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _sets(b: pa.RecordBatch) -> list[np.ndarray]:
    return shingle_sets([x.lower().split() for x in b.column("text").cast(pa.binary()).to_pylist()])


def signed(docs: DataFrame, bands: int, rows: int, m: int = COMPONENTS) -> DataFrame:
    """doc_id, n, fp (digest of the set, null where empty) and bands of each row."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, fp binary, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 1024):
            sets = _sets(b)
            sig = signatures(sets, m)
            keys = band_keys(sig, bands, rows)
            some = [len(s) > 0 for s in sets]
            cols = [
                b.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_digest(s) for s in sets], pa.binary()),
                pa.array([k if x else None for k, x in zip(keys, some, strict=True)], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "fp", "bands"])

    return _texts(docs).mapInArrow(run, schema)


def _full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, set) of the wanted classes, from the text of each class's first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 1024):
            sets = _sets(b)
            cols = [pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["fp", "set"])

    first = classes.join(wanted, "fp", "left_semi").select(F.col("first").alias("doc_id")).distinct()
    sets = _texts(docs).join(first, "doc_id", "left_semi").mapInArrow(run, "fp binary, set array<bigint>")
    return sets.join(wanted, "fp", "left_semi").dropDuplicates(["fp"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT, most: int = COMPONENTS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and fp, for each row of docs (doc_id, text)."""
    bands, rows = tuned(percent / 100, most)
    signed_rows = stored(signed(docs, bands, rows, bands * rows), "near-signed")
    usable = signed_rows.where("fp is not null and doc_id is not null")
    classes = usable.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    classes = stored(classes, "near-classes")

    def sets_of(wanted: DataFrame, with_bands: bool) -> DataFrame:
        sets = _full_sets(docs, classes, wanted)
        return sets.join(classes.select("fp", "bands"), "fp") if with_bands else sets

    roots = class_components(classes, classes, sets_of, percent)
    rooted = classes.select("fp", "first").join(roots, F.col("fp") == F.col("node"))
    least = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = rooted.join(least, "component").select("fp", "component_id")
    of_class = classes.select("fp", "first", "copies").join(of_class, "fp", "left").withColumn("component_id", F.coalesce("component_id", "first"))
    # only rows that share a class or have links need the join; the others are their own component
    of_class = stored(of_class.where("copies > 1 or component_id <> first").drop("first"), "near-named")
    rows = signed_rows.select("doc_id", F.col("n").alias("n_shingles"), "fp")
    out = joined(rows.where("doc_id is not null"), of_class, "fp", "copies")
    out = out.unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), (F.col("doc_id").isNull() | (comp == F.col("doc_id"))).alias("kept"), "fp")


def op8_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one document stays, that of the least doc_id; columns stay.

    Of equal rows (same doc_id, same text) one stays; rows without a doc_id all stay.
    """
    out = near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__rows"))
    left = docs.join(out, "doc_id")
    single = left.where("__rows = 1")
    many = left.where("__rows > 1").dropDuplicates(["doc_id", "text"])
    return single.unionByName(many).select(docs.columns).unionByName(docs.where("doc_id is null"))
