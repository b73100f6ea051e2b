"""Every registered query against its DuckDB oracle (rows where there is none).

``INSIGHT_ORACLE_DIR`` names other tables: larger ones show faults that small ones hide (range sampling).
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_harness import compare, duck

import __spark_entry__ as entry

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


DIR = os.environ.get("INSIGHT_ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, con, DIR, key, QUERIES, ORACLES)
    assert res["status"] in ("ok", "rows-only"), res
    assert res["spark_rows"] > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["APP_ID", "hour", "n_views", "quality_sum", "avg_length"]
    assert len(df.collect()) > 0
