"""Global ranks without a window over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows_before(df: DataFrame, value: str, out: str, buckets: int = 256) -> DataFrame:
    """(value, n, out) for each distinct value: its rows, and the rows of smaller values.

    Values are dealt into ranges at approximate quantiles (at most `buckets` numbers on the driver). Ranges get
    offsets from their sums, and values are ordered inside their range only.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    cuts = sorted(set(df.stat.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.005)))
    counts = counts.withColumn("__b", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0))
    sums = counts.groupBy("__b").agg(F.sum("n").alias("__s"))
    over = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__b", F.coalesce(F.sum("__s").over(over), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.join(sums, "__b").withColumn(out, F.col("__o") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return rows.select(value, "n", out)


def at_positions(df: DataFrame, by: str, value: str, positions: dict[str, Callable[[Column], Column]], buckets: int = 64) -> DataFrame:
    """(by, *positions): the values at 0-based places of each group's sorted values (nulls first); a place is made
    from the group's size, and lies inside it.

    Equal values are counted first. A group's distinct values are dealt into ranges at approximate quantiles, and
    only the ranges that hold a place are ordered, so no group is sorted in one task.
    """
    counts = df.groupBy(by, value).agg(F.count("*").alias("__n"))
    cuts = counts.groupBy(F.col(by).alias("__of")).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000).alias("__c"), F.sum("__n").alias("__size"))
    rows = counts.join(cuts, F.col(by).eqNullSafe(F.col("__of"))).select(by, value, "__n", "__size", F.size(F.filter(F.coalesce("__c", F.array()), lambda c: c < F.col(value))).alias("__b"))
    sums = rows.groupBy(by, "__size", "__b").agg(F.sum("__n").alias("__s"))
    running = lambda part, n, order: F.coalesce(F.sum(n).over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("__o", running([by], "__s", "__b"))
    place = {k: f(F.col("__size")) for k, f in positions.items()}
    holds = lambda first, n: [(F.col(first) <= p) & (p < F.col(first) + F.col(n)) for p in place.values()]
    chosen = sums.where(F.greatest(*[h.cast("int") for h in holds("__o", "__s")], F.lit(0)) == 1).select(F.col(by).alias("__by"), F.col("__b").alias("__at"), "__o")
    inside = rows.join(chosen, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__b") == F.col("__at")))
    inside = inside.withColumn("__first", F.col("__o") + running([by, "__b"], "__n", value))
    return inside.groupBy(by).agg(*[F.max(F.when(h, F.col(value))).alias(k) for k, h in zip(place, holds("__first", "__n"), strict=True)])


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, out): 1-based ranks, equal values share their mean rank."""
    return rows_before(df, value, "__before").select(value, (F.col("__before") + (F.col("n") + 1) / 2).alias(out))
