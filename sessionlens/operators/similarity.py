"""Joins of vectors by cosine that skip what cannot be near enough.

Vectors of length one lie in cells around centres. A probe first meets the cell of its nearest centre, which gives it a
k-th best; then it is sent only to those other cells whose members may be nearer than that: by the triangle inequality
none is nearer than the probe's distance to the centre less the cell's radius. Near cells share a pen, to which a probe is
sent once for all of them. Pens and the probes sent to them are cut into blocks, so that a task holds two blocks and passes on
at most top_k rows a probe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions import vectors as V
from sessionlens.operators.shared import checkpointed
from sessionlens.operators.vector_index import block_rows, celled, fitted, pens, squares, usable

#: Cells at most; every probe is compared with all centres.
MOST_CELLS = 1024
#: Cosines are summed in another order than a distance is, and distances of near vectors are roots of small numbers.
SLACK = 1e-6


def unit(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, __v): rows whose vector has a direction, at length one."""
    made = rows.where(usable(F.col(vector))).select(F.col(key).alias("k"), V.doubles(F.col(vector)).alias("__v"))
    made = made.withColumn("__n", V.norm(F.col("__v"))).where("__n > 0")
    return made.select("k", F.transform("__v", lambda x: x / F.col("__n")).alias("__v"))


class CosineJoin:
    """Each probe's top_k members by cosine >= least, but itself: `edges` (src, tgt, weight); ties go by tgt.

    probes and members are tables of `unit`; `compared` is the number of pairs that were asked for;
    where more than half of a pen is, all of it is multiplied.
    """

    def __init__(self, probes: DataFrame, members: DataFrame, top_k: int, least: float, block: int | None = None, cells: int | None = None) -> None:
        self.top_k, self.least, self.compared = top_k, least, 0
        self.spark = members.sparkSession
        self.kind = members.schema["k"].dataType.simpleString()
        n = members.count()
        self.block = block or block_rows(n)
        centres = fitted(members, "k", cells or max(1, min(MOST_CELLS, round(n**0.5))), n=n)
        if not n or not len(centres):
            self.edges = self.spark.createDataFrame([], f"src {self.kind}, tgt {self.kind}, weight double")
            return
        made = checkpointed(celled(members, centres))
        # one row for each cell
        found = made.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).orderBy("cell").collect()
        used, radii, sizes = np.array([r["cell"] for r in found]), np.array([r["far"] for r in found]), np.array([r["n"] for r in found])
        order, pen = pens(centres[used], sizes, self.block)
        used, radii, sizes, centres = used[order], radii[order], sizes[order], centres[used[order]]
        self.pen_rows = np.bincount(pen, weights=sizes).astype(int).tolist()
        of = self.spark.createDataFrame(list(zip(used.tolist(), pen.tolist(), strict=True)), "cell int, pen int")
        self.members = made.join(F.broadcast(of), "cell")
        limit = float(np.sqrt(max(0.0, 2 - 2 * least)))

        def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if len(pdf):
                    near = squares(np.stack(pdf["__v"].to_numpy()), centres).argmin(axis=1)
                    yield pdf.assign(pen=pen[near], cells=[used[i : i + 1] for i in near], asked=sizes[near])

        def all_near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for at in range(0, len(pdf), 512):
                    part = pdf.iloc[at : at + 512]
                    reach = np.minimum(limit, np.sqrt(np.maximum(2 - 2 * part["worst"].fillna(least).to_numpy(), 0)))
                    bound = np.sqrt(squares(np.stack(part["__v"].to_numpy()), centres)) - radii[None, :]
                    row, to = np.nonzero(bound <= reach[:, None] + SLACK)
                    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (pen[to[1:]] != pen[to[:-1]])]) if len(row) else row
                    ends = np.r_[first[1:], len(row)] if len(row) else first
                    cells = [used[to[i:j]] for i, j in zip(first.tolist(), ends.tolist(), strict=True)]
                    asked = np.add.reduceat(sizes[to], first) if len(row) else row
                    made = part.iloc[row[first]][["k", "__v", "worst"]]
                    yield made.assign(pen=pen[to[first]], cells=pd.Series(cells, index=made.index, dtype=object).to_numpy(), asked=asked)

        sent = "pen int, cells array<int>, asked long"
        first = checkpointed(probes.mapInPandas(nearest, f"k {self.kind}, __v array<double>, {sent}"))
        near = self._products(first.withColumn("worst", F.lit(None).cast("double")))
        # the k-th best of the nearest cell, of probes that have as many; that cell is met again among all
        worst = near.groupBy("src").agg(F.when(F.count("*") >= top_k, F.min("weight")).alias("worst")).withColumnRenamed("src", "k")
        known = checkpointed(first.select("k", "__v").join(worst, "k", "left"))
        self.edges = self._products(known.mapInPandas(all_near, f"k {self.kind}, __v array<double>, worst double, {sent}"))

    def _best(self, found: DataFrame) -> DataFrame:
        w = Window.partitionBy("src").orderBy(F.desc(F.round("weight", 12)), "tgt")
        return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= self.top_k).drop("r")

    def _products(self, probes: DataFrame) -> DataFrame:
        """Best members for probes (k, __v, worst, pen, cells) in the cells that each names; worst: less is of no use."""
        counts = probes.groupBy("pen").agg(F.count("*").alias("n"), F.sum("asked").alias("asked")).collect()
        self.compared += sum(r["asked"] for r in counts)
        slices = [(r["pen"], -(-r["n"] // self.block), -(-self.pen_rows[r["pen"]] // self.block)) for r in counts]
        cut = F.broadcast(self.spark.createDataFrame(slices, "pen int, parts int, blocks int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
        none = lambda t: F.lit(None).cast(t)
        left = probes.join(cut, "pen").select("pen", "k", "__v", "worst", "cells", none("int").alias("cell"), part("parts").alias("i"), every("blocks").alias("j"), F.lit(0).alias("side"))
        right = self.members.join(cut, "pen").select("pen", "k", "__v", none("double").alias("worst"), none("array<int>").alias("cells"), "cell", every("parts").alias("i"), part("blocks").alias("j"), F.lit(1).alias("side"))
        top_k, least = self.top_k, self.least

        def best(pdf: pd.DataFrame) -> pd.DataFrame:
            a, c = pdf[pdf.side == 0], pdf[pdf.side == 1].sort_values("cell", kind="stable")
            out: list[tuple] = []
            if len(a) and len(c):
                y, ids, cell = np.stack(c["__v"].to_numpy()), c.k.to_numpy(), c.cell.to_numpy()
                start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                size, names = np.diff(np.r_[start, len(cell)]), cell[start]
                floor = np.maximum(a.worst.fillna(-2.0).to_numpy() - SLACK, least)
                for at in range(0, len(a), 128):
                    part = a.iloc[at : at + 128]
                    x = np.stack(part["__v"].to_numpy())
                    open_ = np.stack([np.isin(names, w) for w in part.cells])
                    if open_.mean() > 0.5:
                        sim = x @ y.T
                        sim[~np.repeat(open_, size, axis=1)] = -3
                    else:
                        sim = np.full((len(x), len(y)), -3.0)
                        for j in np.flatnonzero(open_.any(axis=0)):
                            who = np.flatnonzero(open_[:, j])
                            sim[who, start[j] : start[j] + size[j]] = x[who] @ y[start[j] : start[j] + size[j]].T
                    sim[part.k.to_numpy()[:, None] == ids[None, :]] = -3
                    for k, s, low in zip(part.k.tolist(), sim, floor[at : at + 128], strict=True):
                        hit = np.flatnonzero(s >= low)
                        if len(hit):
                            hit = hit[np.lexsort((ids[hit], -np.round(s[hit], 12)))][:top_k]
                            out += [(k, ids[h], s[h]) for h in hit]
            return pd.DataFrame(out, columns=["src", "tgt", "weight"])

        found = left.unionByName(right).groupBy("pen", "i", "j").applyInPandas(best, f"src {self.kind}, tgt {self.kind}, weight double")
        return self._best(found)


def block_pairs(made: DataFrame, found: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, block: int | None = None) -> DataFrame:
    """found(keys, other keys, cosines) over every two rows of `unit` once, in pieces of block products.

    Rows are dealt into blocks by hash, a task has two of them. Two rows of one key have cosine nan; so has the second
    of a pair where a block meets itself. What is sent grows with the rows times the number of blocks."""
    n = made.count()
    blocks = max(1, -(-n // (block or block_rows(n))))
    rows = made.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    one = rows.select("k", "__v", F.col("b").alias("i"), F.explode(F.sequence("b", F.lit(blocks - 1))).alias("j"), F.lit(0).alias("side"))
    other = rows.select("k", "__v", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("i"), F.col("b").alias("j"), F.lit(1).alias("side")).where("i < j AND i >= 0")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        itself = pdf.i.iloc[0] == pdf.j.iloc[0]
        a = pdf[pdf.side == 0]
        c = a if itself else pdf[pdf.side == 1]
        if not (len(a) and len(c)):
            return pd.DataFrame(columns=names)
        x, y, keys, others, out = np.stack(a["__v"].to_numpy()), np.stack(c["__v"].to_numpy()), a.k.to_numpy(), c.k.to_numpy(), []
        for at in range(0, len(x), 128):
            sim = x[at : at + 128] @ y.T
            if itself:
                sim[np.arange(len(y))[None, :] <= np.arange(at, at + len(sim))[:, None]] = np.nan
            sim[keys[at : at + 128, None] == others[None, :]] = np.nan
            out.append(found(keys[at : at + 128], others, sim))
        return pd.concat(out)

    return one.unionByName(other).groupBy("i", "j").applyInPandas(run, schema)


def pairs_above(rows: DataFrame, key: str, vector: str, least: float, block: int | None = None) -> DataFrame:
    """(src, tgt, weight): all pairs of rows with cosine >= least > 0, the lesser key first; no pair is sent on."""
    made = checkpointed(unit(rows, key, vector))
    kind = made.schema["k"].dataType.simpleString()

    def above(keys: np.ndarray, others: np.ndarray, sim: np.ndarray) -> pd.DataFrame:
        row, to = np.nonzero(sim >= least)
        return pd.DataFrame({"k": keys[row], "o": others[to], "weight": sim[row, to]})

    found = block_pairs(made, above, f"k {kind}, o {kind}, weight double", block)
    return found.select(F.least("k", "o").alias("src"), F.greatest("k", "o").alias("tgt"), "weight")


def extremes(rows: DataFrame, key: str, vector: str, block: int | None = None) -> tuple[float | None, float | None]:
    """The least and the largest cosine of two rows, in one pass over block products."""

    def ends(keys: np.ndarray, others: np.ndarray, sim: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"least": [np.fmin.reduce(sim, axis=None)], "most": [np.fmax.reduce(sim, axis=None)]})

    found = block_pairs(checkpointed(unit(rows, key, vector)), ends, "least double, most double", block)
    found = found.where("least IS NOT NULL AND NOT isnan(least)")
    return tuple(found.agg(F.min("least"), F.max("most")).first())


def mean_cosine(rows: DataFrame, key: str, vector: str) -> float | None:
    """The mean cosine of two rows, from the sum of all vectors: no pair is made."""
    long = unit(rows, key, vector).select("k", F.posexplode("__v").alias("pos", "x"))
    n = long.where("pos = 0").count()
    total = long.groupBy("pos").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return (total - n) / (n * (n - 1)) if n > 1 else None
