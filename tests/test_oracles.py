"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from seqloom.plans import catalogue, more  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(table):
    columns = sorted(table.column_names)
    return sorted(map(repr, table.select(columns).to_pandas().itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR).toArrow()
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows(got) == rows(want)
    else:
        assert got.num_rows > 0
