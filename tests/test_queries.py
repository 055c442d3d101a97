"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tests.conftest import SF
from veldt.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Many fits; queries with SQL cover their operators.
SLOW = {"m2_m7_cross_fitted_probability", "m3_tuning_grid", "m8_cross_fitted_threat_values"}
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    text = df.map(lambda v: "null" if pd.isna(v) else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v))
    return sorted(map(tuple, text.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
