"""Every query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from kelpforest import queries as own

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(value) if isinstance(value, list) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(_plain(r[i])) for i in order) for r in rows))


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_sql(spark, tables, duck, name):
    found = own.QUERIES[name](spark, tables)
    expected = duck.execute(own.ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    rows = [tuple(x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x for x in r) for r in expected.fetchall()]
    assert _rows(found.columns, found.collect()) == _rows(columns, rows)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_rows(spark, tables, name):
    assert own.QUERIES[name](spark, tables).count() > 0
