from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parents[1]
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(HOME), os.environ.get("PYTHONPATH", "")]))
sys.path.insert(0, str(HOME))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
