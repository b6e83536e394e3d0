"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from docprep.plans import registry

DATA = os.environ.get("DOCPREP_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float | decimal.Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    return str(x.replace(tzinfo=None)) if isinstance(x, datetime.datetime) else x


def rows(found):
    return sorted((tuple(plain(x) for x in row) for row in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    found = rows(frame.select(*[f"`{c}`" for c in columns]).collect())
    if name not in registry.ORACLE_SQL:
        assert found
        return
    sql = registry.ORACLE_SQL[name]
    assert sorted(r[0] for r in duck.execute(f"DESCRIBE {sql}").fetchall()) == columns
    wanted = ", ".join(f'"{c}"' for c in columns)
    assert found == rows(duck.execute(f"SELECT {wanted} FROM ({sql})").fetchall())
