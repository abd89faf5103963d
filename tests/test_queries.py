"""Every named query against its checking SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from groundplan.sources.tables import TABLES
from tools.check_oracle import kinds, rows_of

FOLDER = "/root/testdata/sf0.001"
PLANS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def checking():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, checking, name):
    df = PLANS[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    if name in SQL:
        cursor = checking.execute(SQL[name])
        names, expected = [d[0] for d in cursor.description], cursor.fetchall()
        assert rows_of(df.columns, rows) == rows_of(names, expected)
        assert kinds(df.columns, rows) == kinds(names, expected)


def test_every_checking_text_has_a_query():
    assert set(SQL) <= set(PLANS)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len({r.project_id for r in rows}) == 25
    assert all(r.sv == pytest.approx(r.ev - r.pv) and r.vac == pytest.approx(r.bac - r.eac) for r in rows)
