"""Registered queries against their SQL on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
SQL = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith("op")}


def plain(v):
    if isinstance(v, (bool, type(None))):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.4f}".replace("-0.0000", "0.0000")
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL)[::6])
def test_query_matches_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    ref = con.execute(SQL[name])
    names = [c[0] for c in ref.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in ref.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want
