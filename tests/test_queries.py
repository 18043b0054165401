"""Every query with SQL against that SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from papyra import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _rows(df, columns):
    say = lambda v: "null" if v is None or pd.isna(v) else repr(float(v)) if not isinstance(v, str) else v
    return sorted(tuple(say(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, sql, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), sql.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _rows(got, columns) == _rows(want, columns)


def test_entry_point(spark):
    assert entry.entry(spark).columns == ["paper_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
