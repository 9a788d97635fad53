"""Every query with SQL gives what DuckDB gives for it."""

from __future__ import annotations

import os

import duckdb
import pytest

from sparkquarry.plans import registry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compared(frame, sql: str, sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    rows = want.fetchall()
    got = frame.collect()
    assert sorted(frame.columns) == sorted(names)

    def norm(row: dict) -> tuple:
        return tuple((k, round(v, 9) if isinstance(v, float) else v) for k, v in sorted(row.items()))

    key = lambda r: repr(r)
    assert sorted((norm(r.asDict()) for r in got), key=key) == sorted((norm(dict(zip(names, r))) for r in rows), key=key)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    compared(registry.queries()[name](spark, SF), registry.oracle_sql()[name])
