import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tempora.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v is pd.NaT or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


#: A small table has no window of 1000 rows and a stride of 500 beyond the first, which is fine; averages are rounded.
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_oracle(spark, con, name):
    got, exp = catalog.QUERIES[name](spark, D).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert rows(got) == rows(exp)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
