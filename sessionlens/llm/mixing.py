"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source, rows are ordered by key and their sizes get a
distributed prefix sum (bucket sums, then offsets inside buckets); each source is cut at its exact budget, whole
epochs first. Sizes are words of the whole text; the budgets are shared by weight under a limit for each source.

Defined results: a null text has size 0; a null source is a source of its own, last in order; an empty table
gives an empty result; repeated rows are documents of their own, ordered among themselves by text; other columns
are ignored (the query) or kept (the stage). Where all sizes are 0 all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlens.llm.common import SMALL, WORD, joined, running_total, stored, table

WEIGHTS = [3, 1, 2]
SHARE = 1.5
MOST = 2
SEED = 17
#: Rows of a bucket of the prefix sums, about.
BUCKET_ROWS = 2_000


def sized(docs: DataFrame, keep: list[str], seed: int = SEED) -> DataFrame:
    """row (a struct of `keep`), source, size in words, key: the hash-random order (of doc_id and text, so that rows
    of one doc_id are dealt out too), and tie."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tie = F.md5(text)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.select(
        F.struct(*keep).alias("row"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), tie)).alias("key"),
        tie.alias("tie"),
    )


def budgets(sizes: DataFrame, weights: list[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row for each source: rows, source_size, target.

    Sources in code-point order, null last, take the weights in turn. The total is shared by weight; a source
    stops at `most` times its size and the excess goes to the others, again by weight. The sources that stop are
    those of the least limit per weight, so one ordered pass over the source table (not the rows) settles it.
    """
    by = sizes.groupBy("no_source", "source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy("no_source", "source")) - 1
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    by = by.withColumn("limit", most * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(every))
    order = every.orderBy(F.col("limit") / F.col("weight"), "no_source", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    by = by.withColumn("left", left).withColumn("weight_left", weight_left)
    by = by.withColumn("stops", F.col("limit") * F.col("weight_left") <= F.col("weight") * F.col("left"))
    # from the first source that doesn't stop, all share what is left then
    first = F.row_number().over(order)
    by = by.withColumn("at", first).withColumn("open_from", F.min(F.when(~F.col("stops"), F.col("at"))).over(every))
    by = by.withColumn("open_left", F.max(F.when(F.col("at") == F.col("open_from"), F.col("left"))).over(every))
    by = by.withColumn("open_weight", F.max(F.when(F.col("at") == F.col("open_from"), F.col("weight_left"))).over(every))
    is_open = F.col("at") >= F.col("open_from")
    shared = F.col("weight") * F.col("open_left") / F.col("open_weight")
    target = F.when(F.coalesce(is_open, F.lit(False)), shared).otherwise(F.col("limit").cast("double"))
    return by.select("no_source", "source", "rows", "source_size", target.cast("double").alias("target"))


def mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source_size, target and `taken` words: whole epochs, then the prefix that fills the budget.

    A source's taken words sum to floor(target) exactly; the document at the cut gives a part.
    """
    buckets = F.greatest(F.ceil(F.col("rows") / BUCKET_ROWS), F.lit(1))
    plan = stored(plan, "mix-plan")
    # a row for each source; to all executors where they are few, else only those of hot sources, so that no exchange
    # by source alone gathers one
    if len(plan.take(SMALL + 1)) <= SMALL:
        rows = rows.join(F.broadcast(plan), ["no_source", "source"])
    else:
        name = F.concat(F.col("no_source").cast("string"), F.lit(":"), F.col("source"))
        rows = joined(rows.withColumn("__of", name), plan.withColumn("__of", name).drop("no_source", "source"), "__of", "rows").drop("__of")
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)))
    rows = running_total(rows, ["no_source", "source"], "bucket", ["key", "tie"], "size", "start")
    goal = F.floor("target")
    size = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(goal / size)
    rest = goal - epochs * size
    part = F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    return rows.withColumn("epochs", epochs).withColumn("part", part).withColumn("taken", epochs * F.col("size") + part)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(sized(table(spark, sf_dir, "documents"), ["doc_id"]), "mix-sizes")
    out = mixed(rows, budgets(rows))
    return out.select("row.doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document once for each epoch that takes it; the one at a cut keeps its first words.

    The columns stay; a repeated document repeats its doc_id. A document of no words is taken in no epoch.
    """
    keep = docs.columns
    rows = mixed(s := sized(docs, keep), budgets(s))
    # `part` may equal a whole text: then it is one more copy
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), F.col("epochs").cast("int")),
        F.when(F.col("part") == F.col("size"), F.array(F.lit(-1).cast("long"))).otherwise(F.array(F.col("part").cast("long"))),
    )
    rows = rows.where("taken > 0").withColumn("words", F.explode(copies)).where("words <> 0")
    head = _head(F.col("row.text"), F.col("words"))
    text = F.when(F.col("words") < 0, F.col("row.text")).otherwise(head)
    out = rows.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in keep:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("row", F.col("row").withField("n_chars", F.char_length(F.col("row.text")).cast(kind)))
    return out.select("row.*")


def _head(text, words):
    """The text up to the end of its n-th word, with the blanks as they are."""
    each = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(each, F.lit(1), words.cast("int")), "")


_SIZES = r"""
sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
    length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]', '', 'g')) AS size,
    md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key, md5(coalesce(text, '')) AS tie
  FROM documents)"""

ORACLE_SQL = f"""
WITH RECURSIVE {_SIZES.strip()},
sources AS (
  SELECT no_source, source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY no_source, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY no_source, source),
ordered AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY (2 * source_size) / CAST(weight AS DOUBLE), no_source, source) AS pos FROM sources),
pass AS (
  SELECT 0 AS done, 1.5 * CAST((SELECT sum(source_size) FROM sources) AS DOUBLE) AS remaining, (SELECT sum(weight) FROM sources) AS weight_left
  UNION ALL
  SELECT done + 1, remaining - cap, weight_left - weight FROM pass JOIN ordered ON pos = done + 1
  WHERE cap * weight_left <= weight * remaining),
final AS (SELECT * FROM pass ORDER BY done DESC LIMIT 1),
plan AS (
  SELECT no_source, source, source_size, CAST(CASE WHEN pos <= done THEN cap ELSE weight * remaining / weight_left END AS DOUBLE) AS target
  FROM ordered, final),
placed AS (
  SELECT doc_id, size, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY s.no_source, s.source ORDER BY key, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN plan p ON s.no_source = p.no_source AND s.source = p.source),
cut AS (
  SELECT *, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS epochs, CAST(floor(target) AS BIGINT) % greatest(source_size, 1) AS rest FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + least(greatest(rest - start, 0), size) AS BIGINT) AS taken
FROM cut
"""
