"""Every query with an oracle against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from sessionlens.plans import library, registry  # noqa: F401

DATA = Path("/root/testdata/sf0.001")


def norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v).astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = norm(registry.queries()[name](spark, str(DATA)).toPandas())
    want = norm(duck.sql(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    registry.queries()[name](spark, str(DATA)).collect()
