"""Near-duplicate embeddings by collision counting on sorted one-dimensional projections.

There are many tables. In each, a vector has a cell (which of a few random rotations' axes it points along most)
and a one-dimensional projection; the rows of a cell are sorted by projection, and two vectors collide there when
each lies in the window centred on the other. The window, the number of tables and the least count of collisions
are calibrated on simulated pairs at the cosine threshold, so that a pair at the threshold is verified with
probability `recall`; the number of axes in a cell follows the number of vectors, so that lists stay short.
Counted pairs are verified by cosine in double precision. A pair is counted in full where it first collides, from
the keys that travel with the rows, and so is linked once. Large cells are dealt into block pairs. What leaves a block
pair is a count of links for each vector and a link to one hub for each group, never the pairs themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
so do rows with a null vec_id (component null, kept); vectors of different lengths link with nothing; equal
vectors are one class and link with one another; repeated vec_ids are rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.common import block_pairs, components, joined, stored, table

THRESHOLD = 0.95
RECALL = 0.99999
SEED = 11
BLOCK = 512


#: Numbers of a dense rotation matrix up to which one is used (32 MB).
DENSE = 1 << 22


@lru_cache(maxsize=4)
def rotations(dim: int, tables: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """Random rotations (dim x tables*axes*dim side by side, or signs for `spun`) and (dim x tables) unit directions
    to sort along."""
    rng = np.random.default_rng([SEED, dim])
    if dim * dim * tables * axes <= DENSE:
        turn = np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(tables * axes)], axis=1)
    else:
        turn = rng.choice(np.array([-1.0, 1.0], dtype=np.float32), (tables, 3, axes, 1 << (dim - 1).bit_length()))
    lines = rng.standard_normal((dim, tables))
    return turn, lines / np.linalg.norm(lines, axis=0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform along the last axis, whose length is a power of two."""
    n, wide = x.shape[-1], 1
    while wide < n:
        y = x.reshape(*x.shape[:-1], n // (2 * wide), 2, wide)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(*x.shape[:-1], n)
        wide *= 2
    return x


def spun(x: np.ndarray, turn: np.ndarray, tables: int, axes: int) -> Iterator[np.ndarray]:
    """For each table the vectors in its `axes` random rotations (n x axes x size): by dense matrices, or for long
    vectors by three rounds of random signs and a Hadamard transform, which need no matrix."""
    n, dim = x.shape
    if turn.ndim == 2:
        y = (x @ turn).reshape(n, tables, axes, dim)
        yield from (y[:, t] for t in range(tables))
        return
    wide = np.zeros((n, 1, turn.shape[-1]), dtype=np.float32)
    wide[:, 0, :dim] = x
    for signs in turn:
        y = wide
        for s in signs:
            y = hadamard(y * s) / np.float32(math.sqrt(turn.shape[-1]))
        yield y


def keys_of(x: np.ndarray, tables: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, projections) of unit vectors, one column a table."""
    n, dim = x.shape
    turn, lines = rotations(dim, tables, axes)
    cells = np.empty((n, tables), dtype=np.int64)
    for t, y in enumerate(spun(x, turn, tables, axes)):
        at = np.abs(y).argmax(axis=2)
        sign = np.take_along_axis(y, at[..., None], axis=2)[..., 0] < 0
        digit, cell = at.astype(np.int64) * 2 + sign, np.zeros(n, dtype=np.int64)
        for k in range(axes):
            cell = cell * (2 * y.shape[2]) + digit[:, k]
        cells[:, t] = cell
    return cells, (x @ lines).astype(np.float32)


def units_of(v: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = v.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@lru_cache(maxsize=16)
def calibrated(dim: int, axes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, float]:
    """(tables, least count, window) for pairs at the threshold, from 4000 simulated ones.

    The window holds such a pair's projections with probability 0.98; tables are added until the count that keeps
    `recall` is at least 2. Raises where no number of tables does.
    """
    rng = np.random.default_rng([SEED, dim, axes])
    x = rng.standard_normal((4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((4000, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    y = threshold * x + math.sqrt(1 - threshold**2) * z / np.maximum(norm, 1e-12)
    trial = 16
    (ca, pa_), (cb, pb) = keys_of(x, trial, axes), keys_of(y, trial, axes)
    window = float(np.quantile(np.abs(pa_ - pb), 0.98))
    p = float(((ca == cb) & (np.abs(pa_ - pb) <= window)).mean()) * 0.95  # a margin for the simulation's own error
    for tables in range(8, 2000, 4):
        miss, least = 0.0, 0
        for k in range(tables):
            miss += math.comb(tables, k) * p**k * (1 - p) ** (tables - k)
            if miss > 1 - recall:
                break
            least = k + 1
        if least >= 2:
            return tables, least, window
    raise ValueError(f"{axes} axes find no pair at {threshold} with probability {recall}")


def axes_for(vectors: int, dim: int) -> int:
    """Axes of a cell so that there are about 16 cells a vector."""
    return max(1, math.ceil(math.log(max(2, 16 * vectors)) / math.log(2 * dim))) if dim > 1 else 1


def classes_of(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """key, fp (digest; null where unusable), vec (the numbers as they are) of each row."""
    kind = "float" if rows.schema[vector].dataType.simpleString() == "array<float>" else "double"
    src = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vec"))
    schema = f"vec_id {src.schema['vec_id'].dataType.simpleString()}, fp binary, vec array<{kind}>"
    number = pa.float32() if kind == "float" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            fp, vec = [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("vec").to_pylist(), strict=True):
                x = np.array(v, dtype=np.float64) + 0.0 if v and i is not None and None not in v else None  # one zero
                good = x is not None and np.isfinite(x).all() and x.any()
                fp.append(xxhash.xxh3_128_digest(x.tobytes()) if good else None)
                vec.append(v if good else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(fp, pa.binary()), pa.array(vec, pa.list_(number))], names=["vec_id", "fp", "vec"])

    return src.mapInArrow(run, schema)


def _keyed(classes: DataFrame, dim: int, tables: int, axes: int) -> DataFrame:
    """classes with cells and lines, a number of each a table; cells are 32-bit numbers where they fit."""
    most = (2 << (dim - 1).bit_length()) ** axes
    whole, name = (pa.int32(), "int") if most < 1 << 31 else (pa.int64(), "bigint")
    schema = f"fp binary, copies bigint, vec {classes.schema['vec'].dataType.simpleString()}, cells array<{name}>, lines array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = units_of(part.column("vec").flatten().to_numpy().reshape(part.num_rows, dim))
                cells, lines = keys_of(x, tables, axes)
                cols = [part.column("fp"), part.column("copies"), part.column("vec"), pa.array(list(cells), pa.list_(whole)), pa.array(list(lines), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["fp", "copies", "vec", "cells", "lines"])

    return classes.select("fp", "copies", "vec").mapInArrow(run, schema)


def hubs(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the pairs (x, y) reach from it."""
    out = np.arange(n)
    while True:
        low = np.minimum(out[x], out[y])
        now = out.copy()
        np.minimum.at(now, x, low)
        np.minimum.at(now, y, low)
        now = now[now]
        if (now == out).all():
            return out
        out = now


def _verified(least: int, window: float, threshold: float):
    """Stream rows sorted by (tab, cell, bi, bj): count and verify the pairs of each group. Gives (fp, null, links to
    rows of other classes) and (fp, hub, null)."""

    def pairs(g: dict, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        tab, side = int(g["tab"][lo]), g["side"][lo:hi]
        line = g["lines"][lo:hi, tab]
        order = np.argsort(line, kind="stable")
        upto = np.searchsorted(line[order], line[order] + np.float32(window), side="right")
        span = upto - np.arange(hi - lo) - 1  # later rows in each query's window
        i = np.repeat(np.arange(hi - lo), span)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(span) - span, span)
        a, b = order[i], order[j]
        if g["bi"][lo] != g["bj"][lo]:
            across = side[a] != side[b]
            a, b = a[across], b[across]
        out_a, out_b = [], []
        for at in range(0, len(a), 1 << 14):
            x, y = a[at : at + (1 << 14)] + lo, b[at : at + (1 << 14)] + lo
            # from one side as in the window above, so that both agree to the last bit
            p, q = np.minimum(g["lines"][x], g["lines"][y]), np.maximum(g["lines"][x], g["lines"][y])
            hit = (g["cells"][x] == g["cells"][y]) & (q <= p + np.float32(window))
            go = (hit.argmax(axis=1) == tab) & (hit.sum(axis=1) >= least)
            x, y = x[go], y[go]
            cos = np.einsum("ij,ij->i", g["vec"][x], g["vec"][y])
            out_a.append(x[cos >= threshold])
            out_b.append(y[cos >= threshold])
        none = np.empty(0, dtype=np.int64)
        return np.concatenate([*out_a, none]), np.concatenate([*out_b, none])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None

        def flush(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            key = [t.column(c).to_numpy() for c in ("tab", "cell", "bi", "bj")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            bounds = [0, *change.tolist()] + ([t.num_rows] if last else [])
            done = bounds[-1]
            if not done:
                return None, t
            head = t.slice(0, done).combine_chunks()
            wide = lambda c: head.column(c).combine_chunks().flatten().to_numpy().reshape(done, -1)
            g = {"tab": key[0], "bi": key[2], "bj": key[3], "side": t.column("side").to_numpy(), "cells": wide("cells"), "lines": wide("lines"), "vec": units_of(wide("vec"))}
            found = [pairs(g, lo, hi) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True) if hi - lo > 1]
            none = np.empty(0, dtype=np.int64)
            x, y = (np.concatenate([none, *(f[k] for f in found)]) for k in (0, 1))
            copies = head.column("copies").to_numpy()
            count = np.zeros(done, dtype=np.int64)
            np.add.at(count, x, copies[y])
            np.add.at(count, y, copies[x])
            counted, hub = np.flatnonzero(count), hubs(done, x, y)
            tied = np.flatnonzero(hub != np.arange(done))
            fp = head.column("fp").combine_chunks()
            a = fp.take(pa.array(np.concatenate([counted, tied])))
            b = pa.concat_arrays([pa.nulls(len(counted), pa.binary()), fp.take(pa.array(hub[tied]))])
            n = pa.concat_arrays([pa.array(count[counted]), pa.nulls(len(tied), pa.int64())])
            return pa.RecordBatch.from_arrays([a, b, n], names=["a", "b", "n"]), t.slice(done)

        for x in batches:
            now = pa.Table.from_batches([x])
            now = pa.concat_tables([tail, now]) if tail is not None and tail.num_rows else now
            if now.num_rows:
                out, tail = flush(now, False)
                if out is not None:
                    yield out
        if tail is not None and tail.num_rows:
            out, _ = flush(tail, True)
            if out is not None:
                yield out

    return run


def links(classes: DataFrame, dim: int, vectors: int, threshold: float = THRESHOLD) -> DataFrame:
    """Of classes (fp, copies, vec of one length): (a, null, n) rows, whose sum over n is how many rows of other
    classes a is linked with, and (a, b, null) rows, links that connect all that pairs with cosine >= threshold do."""
    axes = axes_for(vectors, dim)
    tables, least, window = calibrated(dim, axes, threshold)
    keyed = stored(_keyed(classes.where(F.size("vec") == dim), dim, tables, axes), "cos-keys")
    rows = keyed.select("fp", F.posexplode("cells").alias("tab", "cell"))
    dealt = block_pairs(rows, ["tab", "cell"], "fp", BLOCK)
    dealt = dealt.join(keyed, "fp").repartition("tab", "cell", "bi", "bj").sortWithinPartitions("tab", "cell", "bi", "bj")
    return dealt.mapInArrow(_verified(least, window, threshold), "a binary, b binary, n bigint")


def near_duplicates(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    every = stored(classes_of(rows, vector, key), "cos-rows")
    classes = every.where("fp is not null").groupBy("fp").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = stored(classes, "cos-classes")
    # one row for each vector length in use, which is a property of the model and not of the data's size
    dims = classes.groupBy(F.size("vec").alias("dim")).count().collect()
    found = None
    for d in dims:
        one = links(classes, d["dim"], d["count"], threshold)
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = every.select(F.col("fp").alias("a"), F.col("fp").alias("b"), F.lit(0).cast("long").alias("n")).where("false")
    found = stored(found, "cos-links")
    linked = found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked"))
    rooted = classes.select("fp", "first").join(components(found.where("b is not null")), F.col("fp") == F.col("node"))
    least = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    rooted = rooted.join(least, "component").select("fp", "component_id")
    of_class = classes.select("fp", "first", "copies").join(linked, F.col("fp") == F.col("a"), "left").join(rooted, "fp", "left")
    of_class = of_class.select("fp", "copies", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = joined(every.select("vec_id", "fp"), stored(of_class, "cos-named"), "fp", "copies")
    comp = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("vec_id").isNull() | (comp == F.col("vec_id"))).alias("kept"))


def op6_collision_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
