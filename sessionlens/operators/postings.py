"""A stored index of postings: a lookup reads the partitions of its query's terms, not the corpus."""

from __future__ import annotations

import math
from zlib import crc32

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sessionlens.functions import text as T
from sessionlens.operators.retrieval import IDF_FLOOR, K1, B

BUCKETS = 256


def _bucket(term: Column, buckets: int) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def written(docs: DataFrame, key: str, text: str, folder: str, buckets: int = BUCKETS) -> None:
    """Write folder/postings (doc, dl, term, tf by bucket of the term) and folder/stats (n, avgdl, buckets, schema) anew.

    key is unique and null texts are empty. A bucket that a frequent term makes large is split into several files
    at run time; files are sorted by term, so that row groups of other terms are skipped.
    """
    _append(docs, key, text, folder, buckets, "error")


def added(docs: DataFrame, key: str, text: str, folder: str) -> None:
    """Index more documents: another segment of postings, and another row of statistics."""
    _append(docs, key, text, folder, stats(docs.sparkSession, folder)["buckets"], "append")


def stats(spark: SparkSession, folder: str) -> dict:
    """n, avgdl, buckets and schema over all segments, of which each has a row."""
    rows = spark.read.parquet(f"{folder}/stats").collect()
    n = sum(r["n"] for r in rows)
    return {"n": n, "avgdl": sum(r["n"] * (r["avgdl"] or 0) for r in rows) / n if n else None, "buckets": rows[0]["buckets"], "schema": rows[0]["schema"]}


def _append(docs: DataFrame, key: str, text: str, folder: str, buckets: int, mode: str) -> None:
    # texts are dealt by document, so that its terms are counted where they are: only what is stored goes to its bucket
    dealt = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartition("doc")
    toks = dealt.select("doc", T.tokens(F.col("text")).alias("toks")).withColumn("dl", F.size("toks").cast("long"))
    tf = toks.select("doc", "dl", F.explode("toks").alias("term")).groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
    rows = tf.withColumn("bucket", _bucket(F.col("term"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc")
    # the words of the texts are counted as their postings are written, not by another pass over the texts
    seen = Observation()
    rows.observe(seen, F.sum("tf").alias("words")).write.mode(mode).partitionBy("bucket").parquet(f"{folder}/postings")
    n, words = docs.count(), seen.get.get("words") or 0
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    about = [(n, words / n if n else None, buckets, schema)]
    docs.sparkSession.createDataFrame(about, "n bigint, avgdl double, buckets int, schema string").write.mode(mode).parquet(f"{folder}/stats")


def hits(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """The postings of the terms; only their buckets are listed and read."""
    about = stats(spark, folder)
    wanted = sorted({crc32(t.encode()) % about["buckets"] for t in terms})
    rows = spark.read.schema(about["schema"]).parquet(f"{folder}/postings")  # a folder without postings has no schema
    return rows.where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))


def bm25(spark: SparkSession, folder: str, key: str, query: str, top_k: int) -> DataFrame:
    """(key, score): as retrieval.bm25 over the documents that were indexed."""
    terms = T.query_terms(query)
    about = stats(spark, folder)
    found = hits(spark, folder, terms or [""])
    if not terms or not about["n"]:
        return found.select(F.col("doc").alias(key), F.lit(0.0).alias("score")).limit(0)
    # one number for each term of the query
    df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.count("*").alias("df")).collect()}
    if not df:
        return found.select(F.col("doc").alias(key), F.lit(0.0).alias("score")).limit(0)
    n, avgdl = about["n"], about["avgdl"] or 1.0
    idf = {t: math.log((n - k + 0.5) / (k + 0.5)) for t, k in df.items()}
    weight = F.element_at(F.create_map(*[F.lit(x) for t, v in idf.items() for x in (t, v if v > 0 else IDF_FLOOR)]), F.col("term"))
    one = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    by = found.groupBy("doc").agg(F.sum(one).alias("score"))
    return by.select(F.col("doc").alias(key), "score").orderBy(F.desc("score"), key).limit(top_k)
