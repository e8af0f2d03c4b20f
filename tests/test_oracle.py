"""Every query with SQL gives DuckDB's rows at the smallest size."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = plans.all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, list | np.ndarray):
        return [plain(x) for x in v]
    if pd.isna(v):
        return None
    if isinstance(v, str):
        return v
    return round(float(v), 6)


def rows(frame: pd.DataFrame) -> list[str]:
    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_equals_sql(spark, duck, name):
    fn, sql = QUERIES[name]
    got, want = fn(spark, SF).toPandas(), duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name][0](spark, SF).count() >= 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
