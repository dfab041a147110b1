"""Density clusters of tables that no task holds: the same leaves as cluster.leaf_clusters, from joins.

Three steps. A nearest-neighbour join over cells lists each row's nearest rows, and so gives core distances. The minimum
spanning tree of mutual reachability grows in Boruvka's rounds: every component but the largest finds its lightest edge out,
first among what its rows list; rows that may have a lighter one beyond their lists ask those cells that may hold it by the
triangle inequality; cells whose rows are all of one component are skipped by it. Matrix products find what may be near
enough, and only that is measured. Then the tree is contracted: components that point to each other along their lightest edges merge, and
take in those that point to them in the order of their edges, up to the first edge that leads elsewhere, which is what
merging one edge after another would do. Sizes and states of components decide when a leaf is closed. What is left is
folded in one task once it is no larger than a bound.

Edges are ordered by (distance, lesser key, greater key), so that the tree is one whatever the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions import vectors as V
from sessionlens.operators.shared import written
from sessionlens.operators.vector_index import block_rows, celled, fitted, pens, squares, usable

MOST_CELLS = 1024
#: Nearest rows that each row knows before the tree grows.
LISTED = 16
#: Probes that are compared at once with a block.
CHUNK = 128
#: Edges that one task may fold.
FOLDED = 200_000
SMALL, LEAF, DONE = 0, 1, 2
SLACK = 1e-6
NOISE = ""


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of one vector to many: summed in one order, so that a pair has one distance wherever it is computed."""
    return np.sqrt(((y - x) ** 2).sum(axis=1))


def _approximate(part: pd.DataFrame, x: np.ndarray, rows: pd.DataFrame, y: np.ndarray) -> np.ndarray:
    """Squared distances of probes x to rows y, sorted by cell, that products give; infinite in cells not asked for."""
    cell = rows.cell.to_numpy()
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    names, stop = cell[start], np.r_[start[1:], len(cell)]
    asked = np.array([True if c is None else np.isin(names, c) for c in part.cells] if part.cells.notna().any() else [[True]], dtype=object)
    asked = np.stack([np.broadcast_to(np.asarray(c, dtype=bool), len(names)) for c in asked])
    asked = np.broadcast_to(asked, (len(x), len(names)))
    if asked.mean() > 0.5:
        out = x @ y.T
        out *= -2
        out += (x * x).sum(axis=1)[:, None]
        out += (y * y).sum(axis=1)
        np.maximum(out, 0, out=out)
        return out if asked.all() else np.where(np.repeat(asked, stop - start, axis=1), out, np.inf)
    out = np.full((len(x), len(y)), np.inf)
    for j in np.flatnonzero(asked.any(axis=0)):
        who = np.flatnonzero(asked[:, j])
        out[who, start[j] : stop[j]] = squares(x[who], y[start[j] : stop[j]])
    return out


def _slack(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how much squares of rows x may be off."""
    return 1e-9 * ((x * x).sum(axis=1) + (y * y).sum(axis=1).max())


def _exact(x: np.ndarray, y: np.ndarray, row: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of x[row] and y[to], as `distances` gives them."""
    step = 1 << 16
    return np.concatenate([np.sqrt(((y[to[i : i + step]] - x[row[i : i + step]]) ** 2).sum(axis=1)) for i in range(0, max(len(row), 1), step)])


class _Space:
    """Rows (k, g, __v) in cells of one group each, cells in pens. `meet` brings probes and the rows of cells together."""

    def __init__(self, rows: DataFrame, block: int | None) -> None:
        self.spark = rows.sparkSession
        self.kind = rows.schema["k"].dataType.simpleString()
        self.n = rows.count()
        self.block = block or block_rows(self.n)
        centres = fitted(rows, "k", max(1, min(MOST_CELLS, round(self.n**0.5))), n=self.n)
        made = written(celled(rows, centres).withColumn("cell", (F.col("g") * len(centres) + F.col("cell")).cast("int")))
        # one row for each cell of a group
        found = made.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).orderBy("cell").collect()
        used, radii, sizes = np.array([r["cell"] for r in found]), np.array([r["far"] for r in found]), np.array([r["n"] for r in found])
        self.used, self.radii, self.pen, self.spans, pen_rows = [], [], [], [], []
        for g in np.unique(used // len(centres)).tolist():
            own = np.flatnonzero(used // len(centres) == g)
            order, pen = pens(centres[used[own] % len(centres)], sizes[own], self.block)
            own, pen = own[order], pen + len(pen_rows)
            pen_rows += np.bincount(pen - len(pen_rows), weights=sizes[own]).astype(int).tolist()
            self.spans.append((g, len(self.used), len(self.used) + len(own)))
            self.used += used[own].tolist()
            self.radii += radii[own].tolist()
            self.pen += pen.tolist()
        self.used, self.radii, self.pen = np.array(self.used, dtype=np.int32), np.array(self.radii), np.array(self.pen, dtype=np.int32)
        self.centres, self.pen_rows = centres[self.used % len(centres)] if self.n else centres, pen_rows
        self.rows = self._penned(made)

    def _penned(self, rows: DataFrame) -> DataFrame:
        of = self.spark.createDataFrame(list(zip(self.used.tolist(), self.pen.tolist(), strict=True)), "cell int, pen int")
        return rows.join(F.broadcast(of), "cell")

    def reached(self, probes: DataFrame, keep: list[str], alike: dict | None = None, cores: dict | None = None) -> DataFrame:
        """probes (k, g, __v, worst, *keep) once for each pen with cells whose rows may be within `worst` of them;
        cells: which, null for all.

        alike: for cells of one component, which; probes of it skip them. cores: the largest core distance of each
        cell. With these, what is measured is mutual reachability out of a component: no less than the probe's core,
        and for the nearest cell with another component no more than its far end or the cores."""
        centres, radii, used, pen, spans = self.centres, self.radii, self.used, self.pen, self.spans
        fields = [f for f in probes.schema if f.name in {"k", "g", "__v", "worst", *keep}]
        many = np.bincount(pen)
        own = top = None
        if alike is not None:
            own, top = np.array([alike.get(c) for c in used.tolist()], dtype=object), np.array([cores[c] for c in used.tolist()])

        def sent(part: pd.DataFrame, lo: int, hi: int) -> pd.DataFrame:
            away = np.sqrt(squares(np.stack(part["__v"].to_numpy()), centres[lo:hi]))
            bound, worst = away - radii[None, lo:hi], part["worst"].fillna(np.inf).to_numpy()
            if own is not None:
                core = part["core"].to_numpy()[:, None]
                other = (own[None, lo:hi] != part["comp"].to_numpy().astype(object)[:, None]).astype(bool)
                sure = np.where(other, np.maximum(np.maximum(away + radii[None, lo:hi], top[None, lo:hi]), core), np.inf)
                bound, worst = np.where(other, np.maximum(bound, core), np.inf), np.minimum(worst, sure.min(axis=1))
            row, to = np.nonzero((bound <= worst[:, None] + SLACK) & np.isfinite(bound))
            to = to + lo
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (pen[to[1:]] != pen[to[:-1]])]) if len(row) else row
            n = np.diff(np.r_[first, len(row)])
            cells = [None if m == many[pen[to[i]]] else used[to[i : i + m]] for i, m in zip(first.tolist(), n.tolist(), strict=True)]
            return part.iloc[row[first]].assign(pen=pen[to[first]], cells=pd.Series(cells, index=part.index[row[first]], dtype=object).to_numpy())

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for g, lo, hi in spans:
                    of = pdf[pdf.g == g]
                    for at in range(0, len(of), 512):
                        yield sent(of.iloc[at : at + 512], lo, hi)

        return probes.select(*[f.name for f in fields]).mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", pen int, cells array<int>")

    def meet(self, probes: DataFrame, keep: list[str], found: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        """found(probes, rows) of every block of probes (k, __v, worst, pen, cells, *keep) and block of rows of that pen."""
        asked = {r["pen"]: r["n"] for r in probes.groupBy("pen").agg(F.count("*").alias("n")).collect()}
        slices = [(c, -(-n // self.block), -(-self.pen_rows[c] // self.block)) for c, n in asked.items()]
        cut = F.broadcast(self.spark.createDataFrame(slices, "pen int, parts int, blocks int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
        none = lambda t: F.lit(None).cast(t)
        left = probes.join(cut, "pen").select("pen", "k", "__v", "worst", "cells", none("int").alias("cell"), *keep, part("parts").alias("i"), every("blocks").alias("j"), F.lit(0).alias("side"))
        right = self.rows.join(cut, "pen").select("pen", "k", "__v", none("double").alias("worst"), none("array<int>").alias("cells"), "cell", *keep, every("parts").alias("i"), part("blocks").alias("j"), F.lit(1).alias("side"))
        names = [x.split()[0] for x in schema.split(", ")]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pdf[pdf.side == 0], pdf[pdf.side == 1].sort_values("cell", kind="stable")
            return found(a, b) if len(a) and len(b) else pd.DataFrame(columns=names)

        return left.unionByName(right).groupBy("pen", "i", "j").applyInPandas(run, schema)


def _nearest(space: _Space, many: int) -> DataFrame:
    """(k, o, d): the `many` nearest rows of each row's group, itself among them; equal distances go by o."""

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        y, keys, out = np.stack(b["__v"].to_numpy()), b.k.to_numpy(), []
        rank = pd.factorize(keys, sort=True)[0]
        for at in range(0, len(a), CHUNK):
            part = a.iloc[at : at + CHUNK]
            x = np.stack(part["__v"].to_numpy())
            near = _approximate(part, x, b, y)
            limit = part["worst"].fillna(np.inf).to_numpy() ** 2
            if len(y) > many and not np.isfinite(limit).all():
                limit = np.minimum(limit, np.partition(near, many - 1, axis=1)[:, many - 1])
            row, to = np.nonzero((near <= (limit + _slack(x, y))[:, None]) & np.isfinite(near))
            d = _exact(x, y, row, to)
            order = np.lexsort((rank[to], d, row))
            row, to, d = row[order], to[order], d[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < many
            out.append(pd.DataFrame({"k": part.k.to_numpy()[row[kept]], "o": keys[to[kept]], "d": d[kept]}))
        return pd.concat(out)

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("k").orderBy("d", "o")
        return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= many).drop("r")

    schema = f"k {space.kind}, o {space.kind}, d double"
    own = space.rows.select("k", "g", "__v", "pen", F.lit(None).cast("double").alias("worst"), F.array("cell").alias("cells"))
    worst = best(space.meet(own, [], nearest, schema)).groupBy("k").agg(F.when(F.count("*") >= many, F.max("d")).alias("worst"))
    asking = written(space.rows.join(worst, "k"))
    return best(space.meet(space.reached(asking, []), [], nearest, schema))


def _roots(pointers: DataFrame) -> DataFrame:
    """(c, root) of (c, to): where pointers lead, by doubling; roots point to themselves."""
    now = written(pointers.select("c", F.col("to").alias("root")))
    while True:
        far = now.alias("x").join(now.select(F.col("c").alias("root"), F.col("root").alias("next")), "root").select("c", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        far = written(far)
        now = far.select("c", "root")
        if far.where("moved").isEmpty():
            return now


def _pointers(lightest: DataFrame) -> DataFrame:
    """(c, to, e, root) of (c, o, e): c's lightest edge e leads to o; of two that choose each other the lesser is root."""
    back = lightest.select(F.col("c").alias("o"), F.col("o").alias("back"))
    to = F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o"))
    made = written(lightest.join(back, "o").select("c", "o", "e", to.alias("to")))
    return made.join(_roots(made), "c")


def _edge(d: str = "d", lo: str = "lo", hi: str = "hi"):
    return F.struct(F.col(d).alias("d"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))


def spanning_tree(rows: DataFrame, least: int, block: int | None = None) -> DataFrame:
    """(lo, hi, d): the minimum spanning tree of mutual reachability of rows (k, __v); with g, int, one for each g."""
    space = _Space(rows if "g" in rows.columns else rows.withColumn("g", F.lit(0)), block)
    schema = f"comp {space.kind}, o {space.kind}, d double, lo {space.kind}, hi {space.kind}"
    many = max(LISTED, least)
    listed = written(_nearest(space, many))
    by = listed.groupBy("k").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    core = F.element_at("ds", F.least(F.lit(least), F.size("ds")))
    # what is not listed is no nearer than `bound`; null: all is listed
    cores = written(by.select("k", core.alias("core"), F.when(F.size("ds") >= many, F.element_at("ds", many)).alias("bound")))
    space.rows = written(space.rows.join(cores, "k").withColumn("comp", F.col("k")))
    of = cores.select("k", "core")
    edges = listed.where("k <> o").join(of, "k").join(of.select(F.col("k").alias("o"), F.col("core").alias("other")), "o")
    edges = edges.select(F.least("k", "o").alias("lo"), F.greatest("k", "o").alias("hi"), F.greatest("d", "core", "other").alias("d")).distinct()
    edges = written(edges.select("lo", "hi", "d", F.col("lo").alias("a"), F.col("hi").alias("b")))
    keep = ["core", "comp"]

    def lightest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """The lightest edge out of each component of a, to rows of b."""
        y, core = np.stack(b["__v"].to_numpy()), b.core.to_numpy()
        comps, names = pd.factorize(np.concatenate([a.comp.to_numpy(), b.comp.to_numpy()]))
        keys, ids = pd.factorize(np.concatenate([a.k.to_numpy(), b.k.to_numpy()]), sort=True)
        own, other, mine, its = comps[: len(a)], comps[len(a) :], keys[: len(a)], keys[len(a) :]
        least_yet, out = np.full(len(names), np.inf), []
        for at in range(0, len(a), CHUNK):
            part, c = a.iloc[at : at + CHUNK], own[at : at + CHUNK]
            x, own_core = np.stack(part["__v"].to_numpy()), part.core.to_numpy()
            near = np.maximum(np.maximum(_approximate(part, x, b, y), core[None, :] ** 2), own_core[:, None] ** 2)
            near[c[:, None] == other[None, :]] = np.inf
            limit = np.minimum(np.minimum(near.min(axis=1), part["worst"].fillna(np.inf).to_numpy() ** 2), least_yet[c] ** 2)
            row, to = np.nonzero((near <= (limit + _slack(x, y))[:, None]) & np.isfinite(near))
            if not len(row):
                continue
            d = np.maximum(np.maximum(_exact(x, y, row, to), core[to]), own_core[row])
            lo, hi = np.minimum(mine[at + row], its[to]), np.maximum(mine[at + row], its[to])
            order = np.lexsort((hi, lo, d, c[row]))
            first = order[np.r_[True, np.diff(c[row[order]]) != 0]]
            least_yet[c[row[first]]] = np.minimum(least_yet[c[row[first]]], d[first])
            out.append(pd.DataFrame({"comp": names[c[row[first]]], "o": names[other[to[first]]], "d": d[first], "lo": ids[lo[first]], "hi": ids[hi[first]]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["comp", "o", "d", "lo", "hi"])

    def best(found: DataFrame) -> DataFrame:
        by = found.groupBy("comp").agg(F.min(F.struct("d", "lo", "hi", "o")).alias("m"))
        return by.select("comp", "m.o", "m.d", "m.lo", "m.hi")

    tree = None
    while True:
        sizes = space.rows.groupBy("g", "comp").agg(F.count("*").alias("n"))
        # a group's largest component waits for the others, which all join something
        largest = sizes.groupBy("g").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("left")).select("m.comp", "left").collect()
        if all(r["left"] == 1 for r in largest):
            break
        waiting = F.broadcast(rows.sparkSession.createDataFrame([(r["comp"],) for r in largest], f"comp {space.kind}"))
        ends = ["d", "lo", "hi"]
        known = edges.select(F.col("a").alias("comp"), F.col("b").alias("o"), *ends).unionByName(edges.select(F.col("b").alias("comp"), F.col("a").alias("o"), *ends))
        near = written(best(known.join(waiting, "comp", "left_anti")))
        asking = space.rows.join(waiting, "comp", "left_anti").join(near.select("comp", F.col("d").alias("worst")), "comp", "left")
        asking = written(asking.where("bound <= worst OR (worst IS NULL AND bound IS NOT NULL)"))
        found = near
        if not asking.isEmpty():
            by_cell = space.rows.groupBy("cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.max("core").alias("core")).collect()
            alike = {r["cell"]: r["a"] for r in by_cell if r["a"] == r["b"]}
            more = space.meet(space.reached(asking, keep, alike, {r["cell"]: r["core"] for r in by_cell}), keep, lightest, schema)
            found = written(best(near.unionByName(more)))
        made = found.select("lo", "hi", "d").distinct()
        tree = made if tree is None else written(tree.unionByName(made))
        chosen = found.select(F.col("comp").alias("c"), "o", _edge().alias("e"))
        chosen = chosen.unionByName(waiting.select(F.col("comp").alias("c"), F.col("comp").alias("o"), F.lit(None).cast(chosen.schema["e"].dataType).alias("e")))
        roots = written(_pointers(chosen).select(F.col("c").alias("comp"), "root"))
        space.rows = written(space.rows.join(roots, "comp").drop("comp").withColumnRenamed("root", "comp"))
        for end in ("a", "b"):
            edges = edges.join(roots.withColumnRenamed("comp", end), end).drop(end).withColumnRenamed("root", end)
        edges = written(edges.where("a <> b"))
    return tree if tree is not None else rows.sparkSession.createDataFrame([], f"lo {space.kind}, hi {space.kind}, d double")


def _contracted(points: DataFrame, comps: DataFrame, edges: DataFrame, least: int, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: points (k, c, label), comps (c, size, state) and edges (a, b, d, lo, hi) after what is sure to merge."""
    e = _edge()
    both = edges.select(F.col("a").alias("c"), F.col("b").alias("o"), e.alias("e")).unionByName(edges.select(F.col("b").alias("c"), F.col("a").alias("o"), e.alias("e")))
    chosen = both.groupBy("c").agg(F.min(F.struct("e", "o")).alias("m")).select("c", "m.e", "m.o")
    nodes = written(_pointers(chosen).join(comps, "c"))
    of = nodes.select("c", "root")
    across = both.join(of, "c").join(of.select(F.col("c").alias("o"), F.col("root").alias("other")), "o").where("root <> other")
    exits = across.groupBy("root").agg(F.min("e").alias("exit"))
    nodes = nodes.join(exits, "root", "left").withColumn("is_root", F.col("c") == F.col("root"))
    inside = written(nodes.where(F.col("is_root") | F.col("exit").isNull() | (F.col("e") < F.col("exit"))).withColumn("big", F.col("size") >= least))
    # the edge at which the core has grown to `least` rows: of the first smalls, or the first big one's
    after = inside.where("not is_root")
    head = inside.where("is_root").select("root", F.col("size").alias("at_first"), F.col("big").alias("born"), F.col("state").alias("root_state"))
    first_big = after.where("big").groupBy("root").agg(F.min(F.struct("e", "state")).alias("first_big"))
    by = Window.partitionBy("root").orderBy("e")
    few = after.where("not big").withColumn("r", F.row_number().over(by)).where(F.col("r") < least)
    grown = few.join(head, "root").withColumn("sum", F.col("at_first") + F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    grown = grown.where(F.col("sum") >= least).groupBy("root").agg(F.min("e").alias("grown"))
    core = head.join(first_big, "root", "left").join(grown, "root", "left")
    by_big = F.col("first_big").isNotNull() & (F.col("grown").isNull() | (F.col("first_big.e") < F.col("grown")))
    t1 = F.when(by_big, F.col("first_big.e")).otherwise(F.col("grown"))
    state = F.when(F.col("born"), F.col("root_state")).when(by_big, F.col("first_big.state")).when(F.col("grown").isNotNull(), F.lit(LEAF)).otherwise(F.lit(SMALL))
    core = core.select("root", "born", F.when(~F.col("born"), t1).alias("t1"), state.alias("own"))
    later = after.where("big").join(core, "root").where(F.col("born") | (F.col("e") > F.col("t1")))
    core = written(core.join(later.groupBy("root").agg(F.min("e").alias("t2")), "root", "left"))
    met = inside.join(core, "root")
    joins = F.col("is_root") | ((~F.col("big") | (F.col("e") == F.col("t1"))) & (F.col("t2").isNull() | (F.col("e") < F.col("t2"))))
    name = lambda c: F.concat(F.lit(f"{turn}:"), F.col(c).cast("string"))
    label = (
        F.when(joins & (F.col("own") == DONE), F.lit(NOISE))
        .when(joins & (F.col("own") == LEAF) & F.col("t2").isNotNull(), name("root"))
        .when(joins, F.lit(None))
        .when(~F.col("big") | (F.col("state") == DONE), F.lit(NOISE))
        .otherwise(name("c"))
    )
    moved = written(met.select("c", F.col("root").alias("new"), label.alias("said"), "size", F.when(F.col("t2").isNotNull(), F.lit(DONE)).otherwise(F.col("own")).alias("state"), "e", "is_root"))
    map_ = moved.select("c", "new")
    points = points.join(moved.select("c", "new", "said"), "c", "left").select("k", F.coalesce("new", "c").alias("c"), F.coalesce("label", "said").alias("label"))
    gone = moved.where("not is_root").select("e.lo", "e.hi")
    edges = edges.join(gone, ["lo", "hi"], "left_anti")
    for end in ("a", "b"):
        edges = edges.join(map_.withColumnRenamed("c", end), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    merged = moved.groupBy(F.col("new").alias("c")).agg(F.sum("size").alias("size"), F.max("state").alias("state"))
    comps = comps.join(map_, "c", "left_anti").unionByName(merged)
    return written(points), written(comps), written(edges.select("a", "b", "d", "lo", "hi"))


def _fold(comps: dict, edges: list[tuple], least: int) -> dict:
    """Label of each component's open points: edges (d, lo, hi, a, b) one after another over {c: (size, state)}."""
    parent, size, state = {}, {c: s for c, (s, _) in comps.items()}, {c: t for c, (_, t) in comps.items()}
    open_, label = {c: [c] for c in comps}, dict.fromkeys(comps, NOISE)

    def root(c):
        while c in parent:
            if parent[c] in parent:
                parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for _, _, _, a, b in sorted(edges):
        a, b = root(a), root(b)
        if len(open_[a]) < len(open_[b]):
            a, b = b, a
        big_a, big_b = size[a] >= least, size[b] >= least
        if big_a and big_b:
            for c in (a, b):
                if state[c] == LEAF:
                    label.update(dict.fromkeys(open_[c], f"end:{c}"))
                open_[c] = []
            state[a] = DONE
        else:
            now = state[a] if big_a else state[b] if big_b else LEAF if size[a] + size[b] >= least else SMALL
            state[a] = now
            if now == DONE:
                open_[a] = []
            else:
                open_[a] += open_[b]
        size[a] += size[b]
        parent[b] = a
        open_.pop(b)
    return label


def leaf_labels(points: DataFrame, tree: DataFrame, least: int, folded: int = FOLDED) -> DataFrame:
    """(k, label): the leaf that each of points (k) is in, null for noise. tree: lo, hi, d."""
    comps = points.select(F.col("k").alias("c"), F.lit(1).cast("long").alias("size"), F.lit(LEAF if least <= 1 else SMALL).alias("state"))
    edges = tree.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "d", "lo", "hi")
    points = points.select("k", F.col("k").alias("c"), F.lit(None).cast("string").alias("label"))
    turn = 0
    while edges.count() > folded:
        points, comps, edges = _contracted(points, comps, edges, least, turn)
        turn += 1
    kind = points.schema["c"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf.d.isna()]
        made = _fold({c: (int(s), int(t)) for c, s, t in zip(nodes.a, nodes["size"], nodes.state, strict=True)}, [(d, lo, hi, a, b) for d, lo, hi, a, b in pdf[pdf.d.notna()][["d", "lo", "hi", "a", "b"]].itertuples(index=False)], least)
        return pd.DataFrame({"c": list(made), "said": list(made.values())})

    # no more rows than twice the bound
    none = lambda t: F.lit(None).cast(t)
    both = comps.select(*[F.col("c").alias(x) for x in ("a", "b", "lo", "hi")], none("double").alias("d"), "size", "state")
    both = both.unionByName(edges.select("a", "b", "lo", "hi", "d", none("long").alias("size"), none("int").alias("state")))
    ends = both.groupBy(F.lit(0).alias("all")).applyInPandas(lambda p: run(p), f"c {kind}, said string")
    out = points.join(ends, "c", "left").select("k", F.coalesce("label", "said").alias("label"))
    return out.select("k", F.when(F.col("label") != NOISE, F.col("label")).alias("label"))


def clustered(rows: DataFrame, key: str, vector: str, least: int, block: int | None = None, folded: int = FOLDED, by: str | None = None) -> DataFrame:
    """(key, cluster): as cluster.leaf_clusters over all rows; clusters by least member, -1 is noise or no vector.

    With `by`, (by, key, cluster): one run for each int `by`; keys differ."""
    group = F.col(by) if by else F.lit(0)
    made = written(rows.where(usable(F.col(vector))).select(F.col(key).alias("k"), group.alias("g"), V.doubles(F.col(vector)).alias("__v")))
    ids = rows.select(*([by] if by else []), F.col(key).alias("k"))
    n = made.count()
    if n < 2 * least or n < 2:
        return ids.select(*([by] if by else []), F.col("k").alias(key), F.lit(-1).alias("cluster"))
    labels = written(leaf_labels(made.select("k"), spanning_tree(made, least, block), least, folded).join(made.select("k", "g"), "k"))
    # one row for each cluster is numbered
    firsts = labels.where("label is not null").groupBy("g", "label").agg(F.min("k").alias("first"))
    numbers = firsts.select("label", (F.row_number().over(Window.partitionBy("g").orderBy("first")) - 1).alias("cluster"))
    out = ids.join(labels.select("k", "label").join(numbers, "label", "left"), "k", "left")
    return out.select(*([by] if by else []), F.col("k").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
