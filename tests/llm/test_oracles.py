"""Corpus queries against their SQL on the smallest tables."""

import duckdb
import pytest

from conftest_tables import TABLES, table
from strandline.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got, expected = QUERIES[name](spark, str(TABLES)).toPandas(), duck.execute(ORACLE[name]).fetchdf()
    assert table(got) == table(expected)
