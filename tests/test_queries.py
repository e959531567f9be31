"""Every registered query of the tables against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tidemark.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def cells(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in order)] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert cells(df.collect(), df.columns) == cells(found.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
