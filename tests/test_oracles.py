"""Every query of the library that has SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from morpholake.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if v is None or (not isinstance(v, str) and pd.isna(v)) else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    for a, b in zip(rows(ours), rows(theirs), strict=True):
        assert a == pytest.approx(b, abs=2e-6, nan_ok=True) if all(not isinstance(x, str) for x in a) else a == b


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 5
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["bootstrap_rows", "nnaa_table"])
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
