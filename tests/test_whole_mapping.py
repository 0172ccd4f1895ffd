"""Failures of the mapping join: every name of the table, against the SQL over all of them."""

import duckdb

from morpholake.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_all_names(spark):
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{DATA}/part.parquet'")
    theirs = con.sql(ORACLE_SQL["mapping_join_failures"])
    ours = QUERIES["mapping_join_failures"](spark, DATA).select(*theirs.columns)
    rows = sorted(map(tuple, ours.collect()))
    assert rows == sorted(theirs.fetchall()) and {name for name, _ in rows} & {n for (n,) in con.sql("select p_name from part").fetchall()}
