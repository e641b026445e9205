"""Every query with SQL gives the SQL's rows; the others give rows."""

import math
import os

import duckdb
import pytest

from gramweave.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([cell(r[i]) for i in order] for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in ORACLES:
        assert got[1]
        return
    cursor = duck.execute(ORACLES[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        for x, y in zip(a, b, strict=True):
            if x != y:
                assert abs(float(x) - float(y)) <= 2e-5, (a, b)
