"""Every query with SQL gives the SQL's rows over the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, database, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    relation = database.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    own = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [relation.columns.index(c) for c in columns]
    assert own == Counter(tuple(plain(r[i]) for i in at) for r in relation.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
