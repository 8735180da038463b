"""A few registered queries against their SQL on the smallest tables; `python check.py` runs all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canon

DIR = "/root/testdata/sf0.001"
NAMES = ["event_table", "event_counts", "folds", "seq_forecast_c", "auc", "own_history", "nearest_probe", "path_redaction"]


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="supplied tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    want = canon(cur.fetchall(), [d[0] for d in cur.description])
    df = entry.queries()[name](spark, DIR)
    assert canon([tuple(r) for r in df.collect()], df.columns) == want
