"""Every registered query equals its DuckDB oracle on the smallest fixture."""

import math
import os

import duckdb
import pytest

from tests.conftest import SF_SMALL
from tillroll.plans import oracle, registry

QUERIES = registry.build()
SQL = oracle.build()
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, round(v, 6))
    return (2, str(v))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(_norm(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_every_query_has_oracle_or_is_a_model_fit():
    models = {"basket_value_gbt", "clv_rf", "churn_model"}
    assert set(QUERIES) - set(SQL) == models
    assert set(SQL) <= set(QUERIES)
