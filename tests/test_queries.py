"""Registered queries against their DuckDB counterparts on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from noteloom.plans import registry
from tests.conftest import SF


def oracle(sql: str) -> pd.DataFrame:
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db.execute(sql).df()


def plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(round(float(v), 9) if isinstance(v, (int, float)) else str(v) for v in row) for row in frame.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_oracle(spark, name):
    found, wanted = registry.QUERIES[name](spark, SF).toPandas(), oracle(registry.ORACLE[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert plain(found) == plain(wanted)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
