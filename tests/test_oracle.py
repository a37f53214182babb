"""Every registered query against its DuckDB oracle on the smallest scale.

The driver runs the same comparison at sf0.01 (tools/oracle_check.py).
"""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, digest

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_is_registered_with_a_builder():
    assert set(SQL) <= set(QUERIES)
    own = {n for n in QUERIES if not n.startswith("op") or n == "open_load" or n == "open_ops" or n == "ops_load" or n == "ops_read"}
    assert own - set(SQL) - {"pipeline"} == {"forecast"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(SQL[name])
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    assert digest(df.columns, got)[0] == digest(rel.columns, want)[0]


def test_forecast_rows_only(spark):
    out = QUERIES["forecast"](spark, SF_SMALL)
    assert out.columns == ["serie", "ds", "yhat", "yhat_lower", "yhat_upper", "trend", "weekly", "yearly"]
    assert out.count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["tipo", "operativo", "cargas_posibles_adicionales", "velocidad_promedio_dias", "eficacia_historica", "indice_estrategico"]
    assert df.count() >= 0
