"""Every registered query with an oracle equals its DuckDB SQL at sf0.001
(the correctness gate, in small)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from retainly.sources.tables import TABLES

from .conftest import SF_SMALL

ORACLES = E.oracle_sql()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    drows = sorted(tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in cur.fetchall())
    assert srows == drows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "customer_id" in df.columns
