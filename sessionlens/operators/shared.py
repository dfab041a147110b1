"""The folder that all executors share, and tables cut off from their lineage in it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; one is made only for a local session without."""
    sc = spark.sparkContext
    if not (found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sl_ckpt_")
        sc.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. Unlike a checkpoint's, its plan keeps nothing of what is known of the
    columns, which in rounds of joins grows with every round."""
    path = os.path.join(shared_folder(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
