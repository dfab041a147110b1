"""All queries of the engine by name, each beside the SQL that checks it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sessionlens.sources.standins import SELECTS, frames, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def add(name: str, views: str, sql: str | None = None):
    """Register f(*frames of `views`) under `name`; `sql` is the oracle's body over the same stand-ins."""
    names = views.split()
    used = [v for v in names if v in SELECTS]
    made = with_views(sql, *used) if sql and used else sql

    def wrap(f):
        query(name, made)(lambda spark, sf_dir: f(*frames(spark, sf_dir, *names)))
        return f

    return wrap


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, unless their Python finds it by path already."""
    sc = spark.sparkContext
    home = Path(__file__).resolve().parents[2]
    places = [Path.cwd(), *map(Path, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))]
    if getattr(sc, "_sessionlens_shipped", False) or any(p.resolve() == home for p in places):
        return
    folder = tempfile.mkdtemp(prefix="sl_ship_")  # the driver serves the archive from here while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/sessionlens", "zip", home, "sessionlens"))
    sc._sessionlens_shipped = True
