"""The entry module works with and without the text subpackage."""

import os

import duckdb
import pytest

import __spark_entry__
from tidemark import catalog

SMALL = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(catalog.queries()) > 90


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", ["rate_hourly", "zip_with_index", "group_adjacent_by_limit", "interleave_all", "switch_map", "text_lines"])
def test_rows_equal_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "documents", "embeddings"):
        db.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = catalog.queries()[name](spark, SMALL)
    names = sorted(df.columns)
    mine = sorted(map(str, (tuple(r[c] for c in names) for r in df.collect())))
    theirs = db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in names)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert mine == sorted(map(str, theirs))
