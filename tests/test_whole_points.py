"""Canonical points: every point of every record, against the SQL over all of them."""

import duckdb
import pytest

from morpholake.plans.oracles import POINTS
from morpholake.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["canonical_points_rollonly", "canonical_points_derotated"])
def test_all_points(spark, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    theirs = con.sql(ORACLE_SQL[name])
    ours = QUERIES[name](spark, DATA).select(*theirs.columns)
    a, b = sorted(map(tuple, ours.collect())), sorted(theirs.fetchall())
    assert len(a) == len(b) == POINTS * con.sql("select count(*) from embeddings").fetchall()[0][0]
    for x, y in zip(a, b, strict=True):
        assert x[:-2] == y[:-2] and x[-2:] == pytest.approx(y[-2:], abs=2e-6)
