"""Registered queries against their SQL at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from quillspark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = plans.queries(), plans.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found) -> list:
    return sorted(tuple(map(repr, (float(x) if isinstance(x, float) else x for x in r))) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows(out.select(*columns).collect()) == rows(duck.execute(f"SELECT {listed} FROM ({ORACLES[name]}) x").fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
