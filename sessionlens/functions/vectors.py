"""Vector functions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / F.when(size > 0, size)).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def mean_vectors(df: DataFrame, by: str, vector: str, out: str = "mean_vec") -> DataFrame:
    """Element-wise mean of `vector` for each `by`: partial sums by position, then one sorted array a group."""
    long = df.select(by, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    mean = long.groupBy(by, "pos").agg(F.avg("x").alias("x"))
    return mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(out))
