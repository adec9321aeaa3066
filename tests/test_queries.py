"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from bindings.queries import QUERIES

TABLES = Path("/root/testdata/sf0.001")
NAMES = sorted(QUERIES)
WITHOUT_SQL = {"train_kfold", "train_holdout"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in TABLES.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def table(frame):
    columns = sorted(frame.columns)
    return sorted(frame[columns].astype(object).where(frame[columns].notna(), None)
                  .itertuples(index=False, name=None), key=repr), columns


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = contract.queries()[name](spark, str(TABLES)).toPandas()
    if name in WITHOUT_SQL:
        assert name not in contract.oracle_sql() and len(got)
        return
    expected = duck.execute(contract.oracle_sql()[name]).fetchdf()
    rows, columns = table(got)
    other, other_columns = table(expected)
    assert columns == other_columns
    assert len(rows) == len(other)
    for mine, theirs in zip(rows, other):
        assert mine == theirs


def test_entry(spark):
    scored = contract.entry(spark)
    assert {"Probability", "Prediction"} <= set(scored.columns) and scored.count() > 0
