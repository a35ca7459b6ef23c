"""Spark queries vs DuckDB oracle SQL on the smallest driver tables (order-insensitive)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
# The slowest oracle keys are covered by the sf0.01 run of tools/check_oracle.py.  encode_auto's
# oracle lists the levels of the sf0.01 data (25 offices -> label codes); at sf0.001 there are
# only 10 offices, so office is one-hot encoded there, as the rule says (same for process_cases).
SKIP = {"kde_curve", "corr_matrix", "numeric_hist_grid", "scatter_matrix_sample", "scan_multi_file_union",
        "encode_auto", "process_cases", "process_petitions"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(k for k in E.oracle_sql() if k not in SKIP))
def test_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert digest(got) == digest(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["office", "median_days", "volume"]
