"""Every query with SQL gives the same rows as the SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from quillspark.catalog.styles import FEATURE_SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# the single-feature queries are columns of extract_features
NAMES = [n for n in entry_point.oracle_sql() if n not in FEATURE_SQL]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == ordered(tuple(plain(r[i]) for i in places) for r in result.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() == 10
