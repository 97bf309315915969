"""Every SQL-expressible query equals its DuckDB oracle (rows, schema,
values) on the smallest fixture; rows-only queries run and return rows."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import compare

SQL = E.oracle_sql()
QUERIES = E.queries()
SQL_NAMES = sorted(SQL)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"fold", "roc_auc", "n_rows", "n_pos"}


@pytest.mark.parametrize("name", SQL_NAMES)
def test_matches_duckdb(spark, duck_small, name):
    status, _rows, _t, msgs = compare(spark, duck_small, name, QUERIES[name], SQL[name], SF_SMALL)
    assert status == "OK", msgs


#: Trained or file-based queries whose rows SQL can't give; the corpus queries have brute-force tests of their own.
ROWS_ONLY = sorted(n for n in set(QUERIES) - set(SQL) if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_gives_rows(spark, name):
    rows = QUERIES[name](spark, SF_SMALL).collect()
    assert rows
    for r in rows:
        for c, v in r.asDict().items():
            if c in ("roc_auc", "prediction", "oof_domain_auc", "holdout_auc", "lh_mean", "lh_min") and v is not None:
                assert 0.0 <= v <= 1.0, (c, v)
