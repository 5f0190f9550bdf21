"""Registered queries against their SQL, and row counts of the others, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from fleethealth.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = queries.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(str, want))


@pytest.mark.parametrize("name,table", [("op3_toxicity", "documents"), ("op4_media_columns", "documents"), ("op5_license_scans", "documents"), ("op8_ngram_jaccard_join", "documents"), ("op10_html_extraction", "pages")])
def test_every_row_has_a_result(spark, con, name, table):
    assert queries.queries()[name](spark, str(DATA)).count() == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
