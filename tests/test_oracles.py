"""Every registered retail query against its DuckDB SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from canasta import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(columns, records):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    duck.execute(plans.ORACLE[name])
    columns = [c[0] for c in duck.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, duck.fetchall())


def test_queries_without_sql_are_the_stated_ones():
    assert set(plans.QUERIES) - set(plans.ORACLE) == set()
