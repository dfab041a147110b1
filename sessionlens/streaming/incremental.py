"""Incremental ingest and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionlens.sources import batches
from sessionlens.sources.tables import upserted


def file_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", per_batch: int | None = None) -> DataFrame:
    """New files of a folder; the query's checkpoint is the ledger of what has been taken in."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(folder)


def once(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """One row for each key within the watermark, whichever path it comes by."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is available through `each` batch and stop."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def upsert_into(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A batch sink: rows replace those with the same keys; the latest by `order` of a batch counts. Replaying a
    batch gives the same table. `path` is folder/table of versioned tables (sources/batches.py)."""
    from pyspark.sql import Window

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        new = batch.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
        folder, name = path.rstrip("/").rsplit("/", 1)
        batches.replaced(spark, folder, name, lambda old: new if old is None else upserted(old, new, keys))

    return run


def tumbling(events: DataFrame, at: str, kind: str, value: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and kind; works on batches and streams."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str) -> DataFrame:
    """Runs of a key's events that are less than `gap` apart."""
    return events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
