"""Density clustering with leaf selection, consolidation of memories, supersession."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.functions import vectors as V
from sessionlens.operators import density
from sessionlens.operators.density import distances


#: Rows whose distances one task may compute.
ONE_TASK = 5_000


def _tree(x: np.ndarray, k: int) -> list[tuple[float, int, int]]:
    """Minimum spanning tree of mutual reachability distances (Prim), as sorted (distance, a, b).

    Of edges of one distance the one of lesser ends is taken, so that there is one tree (density.spanning_tree's)."""
    n = len(x)
    row = lambda i: distances(x[i], x)
    core = np.array([np.partition(row(i), min(k - 1, n - 1))[min(k - 1, n - 1)] for i in range(n)])
    every, inside, best = np.arange(n), np.zeros(n, dtype=bool), np.full(n, np.inf)
    low, high = np.full(n, n), np.full(n, n)
    at, out = 0, []
    for _ in range(n - 1):
        inside[at] = True
        d = np.maximum(np.maximum(row(at), core), core[at])
        lo, hi = np.minimum(every, at), np.maximum(every, at)
        closer = ~inside & ((d < best) | ((d == best) & ((lo < low) | ((lo == low) & (hi < high)))))
        best[closer], low[closer], high[closer] = d[closer], lo[closer], hi[closer]
        free = np.flatnonzero(~inside)
        free = free[best[free] == best[free].min()]
        at = int(free[np.lexsort((high[free], low[free]))[0]])
        out.append((float(best[at]), int(low[at]), int(high[at])))
    return sorted(out)


def leaf_clusters(x: np.ndarray, least: int) -> np.ndarray:
    """Labels of hierarchical density clusters, the leaves of the condensed tree; -1 is noise.

    Core distance counts the point itself among its `least` neighbours. Clusters are numbered by least member.
    """
    n = len(x)
    labels = np.full(n, -1, dtype=int)
    if n < 2 * least or n < 2:
        return labels
    children: dict[int, tuple[int, int]] = {}
    find: dict[int, int] = {}

    def root(i: int) -> int:
        while i in find:
            if find[i] in find:
                find[i] = find[find[i]]
            i = find[i]
        return i

    sizes = dict.fromkeys(range(n), 1)
    nxt = n
    for _, a, b in _tree(x, least):
        a, b = root(a), root(b)
        find[a] = find[b] = nxt
        children[nxt] = (a, b)
        sizes[nxt] = sizes[a] + sizes[b]
        nxt += 1

    def points(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += children[j]
        return out

    # walk down: a true split has both sides of at least `least` points; a cluster with none below is a leaf
    leaves, todo = [], [(nxt - 1, nxt - 1, True)]
    while todo:
        head, at, is_root = todo.pop()
        while at >= n:
            a, b = children[at]
            big = [c for c in (a, b) if sizes[c] >= least]
            if len(big) == 2:
                todo += [(a, a, False), (b, b, False)]
                break
            if not big:
                at = -1
                break
            at = big[0]
        if at < n and not is_root:
            leaves.append(points(head))
    for i, members in enumerate(sorted(leaves, key=min)):
        labels[members] = i
    return labels


def clustered(rows: DataFrame, key: str, vector: str, least: int, by: str | None = None) -> DataFrame:
    """(by, key, cluster): leaf clusters of the vectors, one independent run for each `by`; -1 is noise.

    A group, or all rows, goes to one task only up to ONE_TASK rows; beyond, density.clustered gives the same clusters
    from joins, for all such groups at once.
    """
    if by is None and rows.count() > ONE_TASK:
        return density.clustered(rows, key, vector, least)
    if by is not None:
        # one row for each group that is too large for a task
        large = [r[by] for r in rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > ONE_TASK).collect()]
        if large:
            codes = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(large)), f"__g int, __by {rows.schema[by].dataType.simpleString()}"))
            same = F.col(by).eqNullSafe(F.col("__by"))
            many = density.clustered(rows.join(codes, same).drop("__by"), key, vector, least, by="__g")
            many = many.join(codes, "__g").select(F.col("__by").alias(by), key, "cluster")
            return many.unionByName(_small(rows.join(codes, same, "left_anti"), key, vector, least, by))
    return _small(rows, key, vector, least, by)


def _small(rows: DataFrame, key: str, vector: str, least: int, by: str | None) -> DataFrame:
    group = by or "__all"
    src = rows if by else rows.withColumn("__all", F.lit(0))
    src = src.select(group, key, V.doubles(F.col(vector)).alias("v"))
    out = f"{group} {src.schema[group].dataType.simpleString()}, {key} {src.schema[key].dataType.simpleString()}, cluster int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pdf[[group, key]].assign(cluster=leaf_clusters(np.stack(pdf.v.to_list()), least))

    out_df = src.groupBy(group).applyInPandas(run, out)
    return out_df if by else out_df.drop("__all")


def session_types(clusters: DataFrame) -> DataFrame:
    return clusters.withColumn("session_type", F.when(F.col("cluster") >= 0, F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))).otherwise("noise"))


def prepared(members: DataFrame, vectors: DataFrame, existing: DataFrame | None = None, least_sessions: int = 2, covered: float = 0.8) -> DataFrame:
    """(cluster, member, place, evidence): clusters seen in enough sessions and not yet covered by an existing
    one, members ranked by distance to the centroid.

    members: cluster, member, session_id; vectors: member, vec; existing: old_cluster, member.
    """
    good = members.where("cluster >= 0")
    evidence = good.groupBy("cluster").agg(F.countDistinct("session_id").alias("evidence"), F.countDistinct("member").alias("size")).where(F.col("evidence") >= least_sessions)
    unique = good.select("cluster", "member").distinct()
    if existing is not None:
        share = unique.join(existing, "member").groupBy("cluster", "old_cluster").agg(F.countDistinct("member").alias("hit"))
        share = share.join(evidence, "cluster").where(F.col("hit") / F.col("size") >= covered).select("cluster").distinct()
        evidence = evidence.join(share, "cluster", "left_anti")
    rows = unique.join(evidence, "cluster").join(vectors, "member")
    center = V.mean_vectors(rows, "cluster", "vec", "center")
    rows = rows.join(center, "cluster").withColumn("far", V.l2(F.col("vec"), F.col("center")))
    w = Window.partitionBy("cluster").orderBy(F.round("far", 9), "member")
    return rows.select("cluster", "member", F.row_number().over(w).cast("long").alias("place"), "evidence")


def superseded(new: DataFrame, old: DataFrame, least: float = 0.5) -> DataFrame:
    """(old_cluster, new_cluster): old clusters of whose members a share >= least went into one new cluster; the
    first new cluster (by number) counts."""
    size = old.groupBy("old_cluster").agg(F.countDistinct("member").alias("size"))
    hit = old.join(new, "member").groupBy("old_cluster", "new_cluster").agg(F.countDistinct("member").alias("hit"))
    return hit.join(size, "old_cluster").where(F.col("hit") / F.col("size") >= least).groupBy("old_cluster").agg(F.min("new_cluster").alias("new_cluster"))
