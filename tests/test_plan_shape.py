"""What the physical plans must look like: no Python in the hot path,
broadcast for the checked-small dimension, partial aggregation before shuffles,
pruned scans."""

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["role_playing_join", "attendance_load", "emp_upsert",
                                 "leave_tour_refresh", "title_case", "envelope_explode"])
def test_no_python_udf(spark, key):
    from rollcall import queries as q
    df = {"attendance_load": lambda s, d: q.enrich_attendance(*q._attendance_feed(s, d))}.get(
        key, queries()[key])(spark, SF)
    p = plan(df)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_role_join_broadcasts_checked_dimension(spark):
    p = plan(queries()["role_playing_join"](spark, SF))
    assert p.count("BroadcastHashJoin") >= 2


def test_scan_prunes_columns(spark):
    p = plan(queries()["select_rename"](spark, SF))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in p


def test_distinct_is_partially_aggregated(spark):
    p = plan(queries()["distinct_keys"](spark, SF))
    assert "HashAggregate" in p and p.count("HashAggregate") >= 2


def test_latest_date_is_top_one(spark):
    p = plan(queries()["latest_date"](spark, SF))
    assert "TakeOrderedAndProject" in p


def test_role_join_builds_one_broadcast_for_all_roles(spark):
    from rollcall import queries as q
    df = q.enrich_attendance(*q._attendance_feed(spark, SF))
    df.collect()
    p = plan(df)
    assert "ReusedExchange" in p


def test_landing_scan_prunes_day_folders(spark):
    p = plan(queries()["envelope_landing_scan"](spark, SF))
    assert "PartitionFilters: [isnotnull(reportdate" in p
