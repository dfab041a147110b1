"""Indexes that stand between queries: written once for a state of their source files, read by every lookup."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from sessionlens.plans.ingest import scratch

_FOLDERS: dict[tuple[str, str, str], str] = {}


def snapshot(df: DataFrame) -> str:
    """A digest of the files that df reads: their paths, sizes and times of change."""
    spark = df.sparkSession
    conf, found = spark._jsc.hadoopConfiguration(), []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        at = path.getFileSystem(conf).getFileStatus(path)
        found.append(f"{name} {at.getLen()} {at.getModificationTime()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:24]


def index(df: DataFrame, name: str, write: Callable[[str], None]) -> str:
    """The folder of the index `name` over df's files as they are now; write(folder) makes it where none stands."""
    key = (df.sparkSession.sparkContext.applicationId, name, snapshot(df))
    if key not in _FOLDERS:
        folder = scratch(df.sparkSession, f"{name}-{key[2]}")
        write(folder)
        _FOLDERS[key] = folder
    return _FOLDERS[key]
