"""A stored index of vectors in cells: exact nearest neighbours that read few cells.

Cells are the Voronoi regions of centres fitted on a bounded sample; every row goes to its nearest centre. A folder
holds the rows by cell (a partition each), sorted by their distance from the centre (`far`), the centres, and for each
segment the least and the largest `far` of each cell. By the triangle inequality a row of a cell is no nearer to
a query than |distance to the centre - far|, so a lookup reads cells in the order of that bound until the next bound is
beyond the k-th distance found; within the cells it reads only rows whose `far` may still be near enough.

Rows added later are a new segment in the cells that are there; a segment's bounds are written before its rows, so
a lookup never misses a row that it can see. Rows without a vector, or with a null or non-finite component, are in no
cell and are never found, nor is a zero vector by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.functions import vectors as V

#: Rows that the centres are fitted on, at most; all rows are indexed.
SAMPLE = 20_000
#: Centres at most: a lookup compares its query with all of them.
MOST_CELLS = 4096
ROUNDS = 8
#: Rows of the cells that a step of a lookup reads: the first, and each after it until the last reads what is left.
FIRST_ROWS, STEP_ROWS = 1_000, 2_000_000
SLACK = 1e-9


def usable(v: Column) -> Column:
    """Is it a vector of finite components?"""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _prepared(rows: DataFrame, vector: str, metric: str) -> DataFrame:
    """rows with __v, the vector in double precision (of length one for cosine); those without one are left out."""
    rows = rows.where(usable(F.col(vector))).withColumn("__v", V.doubles(F.col(vector)))
    if metric == "cosine":
        rows = rows.withColumn("__n", V.norm(F.col("__v"))).where("__n > 0").withColumn("__v", F.transform("__v", lambda x: x / F.col("__n"))).drop("__n")
    return rows


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b; close ones are exact enough to order, not to report."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def sampled(rows: DataFrame, key: str, n: int, sample: int) -> list[list[float]]:
    """__v of the `sample` rows whose keys hash least, of n rows (key, __v).

    Every task of a sort with a limit sends the driver as many rows as the limit, so rows are first cut at the hash
    below which a tenth more than the sample are expected; rows are only ordered whole where that leaves too few."""
    few = rows.select(F.xxhash64(F.lit(7), key).alias("h"), "__v")
    most = sample + sample // 10 + 1_000
    if n > most:
        found = few.where(F.col("h") <= int(2**64 * (most / n) - 2**63)).orderBy("h").limit(sample).collect()
        if len(found) == sample:
            return [r["__v"] for r in found]
    return [r["__v"] for r in few.orderBy("h").limit(sample).collect()]


def fitted(rows: DataFrame, key: str, cells: int, sample: int = SAMPLE, n: int | None = None) -> np.ndarray:
    """Centres of `cells` cells at most, by Lloyd's rounds over a sample of the n rows (key, __v), chosen by hash."""
    found = sampled(rows, key, rows.count() if n is None else n, sample)
    if not found:
        return np.empty((0, 0))
    x = np.unique(np.array(found), axis=0)
    centres = x[np.random.default_rng(1).permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        near = squares(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def celled(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows (with __v) with `cell`, the nearest centre, and `far`, the distance to it."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                x = np.stack(pdf["__v"].to_numpy())
                cell = np.concatenate([squares(x[k : k + 512], centres).argmin(axis=1) for k in range(0, len(x), 512)])
                yield pdf.assign(cell=cell.astype(np.int32), far=np.linalg.norm(x - centres[cell], axis=1))

    return rows.mapInPandas(run, kinds + ", cell int, far double")


def pens(centres: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, pen): cells in an order that keeps near ones together, and the pen of each of them in it.

    A pen has cells of about `most` rows together, or one larger cell, so that a probe is sent once for many cells."""
    x = centres - centres.mean(axis=0)
    order = np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")
    pen, at, full = [], 0, 0
    for n in sizes[order].tolist():
        if full and full + n > most:
            at, full = at + 1, 0
        pen.append(at)
        full += n
    return order, np.array(pen, dtype=np.int32)


def block_rows(n: int, least: int = 1024, most: int = 32_768) -> int:
    """Rows of a block of n: an eighth, so that there are tasks enough, between these bounds."""
    return max(least, min(most, -(-n // 8)))


def cells_for(n: int) -> int:
    return max(1, min(MOST_CELLS, round(n**0.5)))


def written(rows: DataFrame, key: str, vector: str, folder: str, metric: str = "l2", keep: list[str] | None = None, cells: int | None = None) -> None:
    """Write the index of rows into a new folder: key, the columns to keep (for filters) and the vectors by cell."""
    spark = rows.sparkSession
    made = _prepared(rows.select(key, vector, *(keep or [])), vector, metric)
    n = made.count()
    centres = fitted(made, key, cells or cells_for(n), n=n)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.drop(vector).schema)
    about = [(key, metric, kinds + ", far double, cell int")]
    spark.createDataFrame(about, "key string, metric string, kinds string").write.parquet(f"{folder}/about")
    listed = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(listed, "cell int, centre array<double>").write.parquet(f"{folder}/centres")
    _append(made.drop(vector), centres, folder)


def added(rows: DataFrame, vector: str, folder: str) -> None:
    """Index more rows (key, vector and the columns kept) as another segment."""
    spark = rows.sparkSession
    about = spark.read.parquet(f"{folder}/about").first()
    centres = _centres(spark, folder)
    if not len(centres):
        raise ValueError("an index of no rows has no cells; write it anew")
    names = [n for n in spark.createDataFrame([], about["kinds"]).columns if n not in ("__v", "far", "cell")]
    _append(_prepared(rows.select(*names, vector), vector, about["metric"]).drop(vector), centres, folder)


def _append(made: DataFrame, centres: np.ndarray, folder: str) -> None:
    if not len(centres):
        return
    rows = celled(made, centres)
    bounds = rows.groupBy("cell").agg(F.min("far").alias("least"), F.max("far").alias("most"), F.count("*").alias("n"))
    bounds.write.mode("append").parquet(f"{folder}/bounds")
    # a large cell is split into several files at run time
    rows.hint("rebalance", "cell").sortWithinPartitions("cell", "far").write.mode("append").partitionBy("cell").parquet(f"{folder}/rows")


def _centres(spark: SparkSession, folder: str) -> np.ndarray:
    found = spark.read.schema("cell int, centre array<double>").parquet(f"{folder}/centres").orderBy("cell").collect()
    return np.array([r["centre"] for r in found])


class Index:
    """An index that stands in `folder`. `read` counts the rows of the cells that the last lookup read."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        about = spark.read.parquet(f"{folder}/about").first()
        self.spark, self.folder, self.key, self.metric, self.kinds = spark, folder, about["key"], about["metric"], about["kinds"]
        self.centres = _centres(spark, folder)
        self.read = 0
        bounds = spark.read.parquet(f"{folder}/bounds") if len(self.centres) else None
        # one row for each cell
        self.bounds = {} if bounds is None else {r["cell"]: (r["least"], r["most"], r["n"]) for r in bounds.groupBy("cell").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")).collect()}

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The indexed rows, of some cells only: a partition filter."""
        if not self.bounds:
            return self.spark.createDataFrame([], self.kinds)
        rows = self.spark.read.schema(self.kinds).parquet(f"{self.folder}/rows")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def knn(self, query: list[float], top_k: int, where: Column | None = None) -> DataFrame:
        """(key, distance): exact nearest rows that pass `where`, nearest first, ties by key.

        The nearest cells give a first k-th distance; cells whose bound is within it are read in steps of a bounded
        number of rows, each of which brings top_k distances to the driver and may close the search; the last step is
        the result's own plan.
        """
        q = np.array(query, dtype=float)
        unit = np.linalg.norm(q) if self.metric == "cosine" else 1.0
        self.read = 0
        if not self.bounds or not len(q) or not unit:
            return self.rows().select(self.key, F.lit(0.0).alias("distance")).limit(0)
        q = q / unit
        literal = V.literal(q.tolist())
        away = np.linalg.norm(self.centres - q, axis=1)
        bound = {c: max(0.0, least - away[c], away[c] - most) for c, (least, most, _) in self.bounds.items()}
        order = sorted(bound, key=lambda c: (bound[c], away[c]))

        def within(cells: list[int], limit: float) -> DataFrame:
            rows = self.rows(cells)
            if limit < float("inf"):
                low, high = min(away[c] for c in cells) - limit, max(away[c] for c in cells) + limit
                rows = rows.where(F.col("far").between(float(low) - SLACK, float(high) + SLACK))
            if where is not None:
                rows = rows.where(where)
            return rows.select(self.key, V.l2(F.col("__v"), literal).alias("distance"))

        best: list[float] = []
        limit, at, step = float("inf"), 0, max(FIRST_ROWS, top_k)
        while True:
            left = [c for c in order[at:] if bound[c] <= limit * (1 + SLACK) + SLACK]
            if sum(self.bounds[c][2] for c in left) <= step and at or not left:
                break
            many = int(np.searchsorted(np.cumsum([self.bounds[c][2] for c in left]), step)) + 1
            found = within(left[:many], limit).orderBy("distance", self.key).limit(top_k).collect()
            best = sorted(best + [r["distance"] for r in found])[:top_k]
            limit = best[-1] if len(best) == top_k else limit
            at, step = at + len(left[:many]), STEP_ROWS
        cells = [c for c in order[: at + len(left)] if bound[c] <= limit * (1 + SLACK) + SLACK]
        self.read = sum(self.bounds[c][2] for c in {*order[:at], *cells})
        if not cells:
            return self.rows([]).select(self.key, F.lit(0.0).alias("distance"))
        out = within(cells, limit)
        # of unit vectors, half the square of their distance is what their cosine lacks to one
        shown = F.col("distance") if self.metric == "l2" else F.col("distance") * F.col("distance") / 2
        return out.select(self.key, shown.alias("distance")).orderBy("distance", self.key).limit(top_k)
