"""Levels of tool calls: every call has one, however long its chain."""

import random

import duckdb

from morpholake.llm import chat
from morpholake.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def brute_levels(after):
    """Level of each call; calls in or behind a circle are left out."""
    out = {}
    while more := {c: 1 + max((out[x] for x in n), default=-1) for c, n in after.items() if c not in out and all(x in out for x in n)}:
        out |= more
    return out


def test_levels(spark):
    rnd = random.Random(6)
    rows, expected = [], {}
    shapes = {
        "chain": {f"c{i}": [f"c{i - 1}"] for i in range(1, 70)} | {"c0": []},
        "late": {f"c{i}": [f"c{i + 1}", f"c{i + 2}"] for i in range(29)} | {"c29": [], "c30": []},
        "some": {f"c{i}": [f"c{rnd.randrange(i)}" for _ in range(rnd.randrange(3))] if i else [] for i in range(40)},
        "circle": {"a": ["b"], "b": ["c"], "c": ["a"], "d": ["c", "e"], "e": [], "f": ["e"], "g": ["g"]},
        "none": {"a": [], "b": []},
    }
    for conv, after in shapes.items():
        rows += [(conv, c, n, [*x, "nowhere", None]) for n, (c, x) in enumerate(after.items())]
        expected |= {(conv, c): n for c, n in brute_levels(after).items()}
    df = spark.createDataFrame(rows, "conv_id string, call_id string, turn int, after array<string>")
    got = chat.levels(df).collect()
    assert len(got) == len(expected) and {(r["conv_id"], r["call_id"]): r["level"] for r in got} == expected
    assert expected["chain", "c69"] == 69


def test_op5_follows_every_call(spark):
    """The query against its SQL: the link to two turns before, and levels, in all conversations."""
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    theirs = con.sql(ORACLE_SQL["op5_tool_calls"])
    ours = QUERIES["op5_tool_calls"](spark, DATA).select(*theirs.columns).collect()
    assert sorted(map(str, map(tuple, ours))) == sorted(map(str, theirs.fetchall())) and max(r["level"] or 0 for r in ours) > 2
