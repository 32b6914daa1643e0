"""Every registered query against its SQL on the smallest tables."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"]


def rows(frame):
    cols = sorted(frame.columns)

    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        return round(float(x), 6) if isinstance(x, numbers.Real) and not isinstance(x, bool) else str(x)

    return cols, sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, con, name):
    assert rows(entry.queries()[name](spark, sf_dir).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "literal", "matched_text", "block_order"]
