"""Seams to outside services, with deterministic offline stand-ins.

A Provider answers prompts, an Embedder gives vectors. Both run inside iterator pandas UDFs, one client for each
partition; equal texts are asked for once. The stand-ins are rules and hashed bags of words: they let everything
run offline and are no equivalent of a model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS = 2000
GROUP, DIRECT = 10, 15


class Embedder(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class Provider(Protocol):
    def complete(self, prompt: str) -> str: ...


class HashedWords:
    """Unit bag-of-words vectors by hashing."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % self.dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class FirstSentence:
    """Answers with the first sentence of what it is asked about."""

    def complete(self, prompt: str) -> str:
        return prompt.split("\n\n", 1)[-1].split(".")[0].strip()[:200]


def embedded(df: DataFrame, text: str, make: Callable[[], Embedder] = HashedWords, out: str = "embedding", batch: int = 64) -> DataFrame:
    """df with the vectors of `text`, cut at MOST_CHARS first; every distinct text is embedded once."""

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for s in it:
            got: list[list[float]] = []
            for at in range(0, len(s), batch):
                got += client.embed_batch(s.iloc[at : at + batch].tolist())
            yield pd.Series(got)

    cut = df.withColumn("__t", F.left(F.coalesce(F.col(text), F.lit("")), F.lit(MOST_CHARS)))
    vectors = cut.select("__t").distinct().withColumn(out, run("__t"))
    return cut.join(vectors, "__t").drop("__t")


def completed(df: DataFrame, prompt: str, make: Callable[[], Provider] = FirstSentence, out: str = "answer") -> DataFrame:
    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for s in it:
            yield s.map(client.complete)

    return df.withColumn(out, run(prompt))


def observed(rows: DataFrame) -> DataFrame:
    """Scores from answers: clipped to [-1, 1]; an answer that is no JSON keeps `fallback` and is marked."""
    got = F.from_json("answer", "score double")["score"]
    score = F.coalesce(got, "fallback")
    return rows.withColumn("parse_failed", got.isNull()).withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)))


def summarized(df: DataFrame, by: str, text: str, order: str, make: Callable[[], Provider] = FirstSentence) -> DataFrame:
    """(by, summary): up to DIRECT texts at once, else groups of GROUP are summarised first."""
    from pyspark.sql import Window

    w = Window.partitionBy(by)
    rows = df.withColumn("__r", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    group = F.when(F.col("__n") > DIRECT, F.floor(F.col("__r") / GROUP)).otherwise(F.lit(0))

    def joined(d: DataFrame, keys: list[str], t: str, o: str) -> DataFrame:
        return d.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(o).alias("o"), F.col(t).alias("t")))), lambda x: x["t"]), "\n").alias("prompt"))

    one = completed(joined(rows.withColumn("__g", group), [by, "__g"], text, order), "prompt", make)
    two = completed(joined(one, [by], "answer", "__g"), "prompt", make, "summary")
    return two.select(by, "summary")
