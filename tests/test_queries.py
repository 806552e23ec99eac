"""Every registered query against its SQL, and the plans that matter at scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare

import __spark_entry__ as entry_point
from gridpulse.catalog import all_queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES = all_queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_sql_and_joins_no_pairs(spark, connection, name):
    frame = QUERIES[name].run(spark, SF_DIR)
    plan = _plan(frame)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare.difference(connection, frame.columns, frame.collect(), QUERIES[name].sql) is None


def test_entry_points(spark):
    assert entry_point.entry(spark).count() > 0
    assert entry_point.queries().keys() >= entry_point.oracle_sql().keys()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, expected",
    [
        ("off_limits", "GreaterThan(value,120.0)"),
        ("time_range", "GreaterThanOrEqual(ts,"),
        ("max_by_epoch", "Not(EqualTo(event_type,view))"),
        ("latest_per_point", "WindowGroupLimit"),
        ("max_by_epoch", "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>"),
        ("count_by_line_big", "ReadSchema: struct<l_linenumber:int>"),
        ("profile_expected", "BroadcastHashJoin"),
        ("limit_rows", "TakeOrderedAndProject"),
    ],
)
def test_plan_has(spark, name, expected):
    assert expected in _plan(QUERIES[name].run(spark, SF_DIR))
