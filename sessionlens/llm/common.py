"""Shared pieces: shared-folder tables, two-level running totals, connected components, block pairs."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than the ASCII blanks (java.util.regex and Python agree on it).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none (as in tests) one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    made = spark.sparkContext.getCheckpointDir()
    if not made:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = "file://" + tempfile.mkdtemp(prefix="sl_ckpt_")
        spark.sparkContext.setCheckpointDir(made)
    return made


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write `df` once as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete the files of tables from `stored` that nothing will read again."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small tables inside iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a table is sent to every executor.
SMALL = 10_000


#: A key with at least this part of all rows is hot; there can be no more hot keys than this.
HOT = 1_000


def joined(rows: DataFrame, table: DataFrame, key: str, rows_of: str) -> DataFrame:
    """rows left-joined with `table` (one row a key), so that no key's rows meet in one task.

    rows_of: the column of `table` that counts the rows of a key. Keys that hold 1 / HOT of all counted rows or
    more, of which there are HOT at most, go to all executors; the others are joined by a shuffle, rows without a key by
    none. `rows` is read three times, so it should be a stored table.
    """
    total = table.agg(F.sum(rows_of)).first()[0] or 0
    hot = F.col(rows_of) * HOT >= total
    few = F.broadcast(table.where(hot))
    rest = rows.where(F.col(key).isNotNull()).join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    out = rows.join(few, key).unionByName(rest.join(table.where(~hot), key, "left"))
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def running_total(df: DataFrame, part: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Add `out`: the exclusive running sum of `value` within `part`, in the order (bucket, *order).

    Two levels, so that no window holds more than one bucket of rows: bucket sums (map-side combined) give
    each bucket's offset, and rows are ordered inside their bucket only. `part` and `bucket` must not be null.
    The one window over buckets sees a row for each bucket, not for each input row.
    """
    keys = [*part, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    over = Window.partitionBy(*(part or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(sums, keys)
        .withColumn(out, F.col("__offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__offset")
    )


def _oriented(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


#: Rows of an edge list up to which its nodes (no more than rows) are sent to every executor.
FEW_EDGES = 100_000


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with the m of their u. least: u, m and n, the rows of u among `total`; nodes with 1 / HOT of
    them, HOT at most, go to all executors, so that no task gathers the rows of a hub. So do all nodes of no more
    than FEW_EDGES rows."""
    if total <= FEW_EDGES:
        return rows.join(F.broadcast(least.drop("n")), "u")
    hot = F.col("n") * HOT >= total
    few = F.broadcast(least.where(hot).drop("n"))
    rest = rows.join(F.broadcast(least.where(hot).select("u")), "u", "left_anti")
    return rows.join(few, "u").unionByName(rest.join(least.where(~hot).drop("n"), "u"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of an undirected edge list: (node, component), component = least node of it.

    Alternating large-star and small-star steps with minimum aggregates and joins; each round's edges go to a
    reliable checkpoint. Nodes without edges don't appear. Null ends and self loops are dropped.
    """
    e = edges.where(F.col(a) != F.col(b)).select(*_oriented(F.col(a), F.col(b))).distinct()
    e = checkpointed(e)
    before, total = None, 2 * e.count()
    for _ in range(rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # large star: every larger neighbour of u goes to u's least neighbour
        large = _with_least(both.where("v > u"), least, total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            _with_least(large, low, total)
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = checkpointed(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == before:
            break
        before, total = now, 2 * now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return root.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def block_pairs(members: DataFrame, keys: list[str], node: str, block: int, weight: str | None = None, most: int = 1 << 22) -> DataFrame:
    """Deal the members of each group (keys) into block pairs: adds `bi`, `bj`, `side`.

    A group of n members becomes b = ceil(n / block) blocks by the hash of `node` (more where the members' weights
    are beyond `most` a block), and each unordered pair of blocks becomes a group of its own of about 2 * block
    rows, so that no task ever holds a whole group. `side` tells the first from the second block; a block paired
    with itself has side 0 only.
    """
    heavy = F.ceil(F.sum(weight) / most) if weight else F.lit(1)
    sizes = members.groupBy(*keys).agg(F.count("*").alias("__n"), heavy.alias("__w")).where("__n > 1")
    dealt = members.join(sizes, keys).withColumn("__b", F.least(F.greatest(F.ceil(F.col("__n") / block), F.col("__w")), F.col("__n")).cast("int"))
    dealt = dealt.withColumn("__k", F.pmod(F.xxhash64(node), F.col("__b")).cast("int"))
    other = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
    return (
        other.withColumn("bi", F.least("__k", "__o"))
        .withColumn("bj", F.greatest("__k", "__o"))
        .withColumn("side", (F.col("__k") > F.col("__o")).cast("int"))
        .drop("__n", "__w", "__b", "__k", "__o")
    )


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of `rows`, so that only a slice's texts are Python objects at a time. At the end
    of a task the memory that Arrow holds back goes to the system, as workers stay for later stages."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()
