"""Key-bucketed sources and the bucketed register: only the buckets in use are read or written."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from rollcall.operators import SchemaClash, lookup_keys
from rollcall.plans import load_attendance, read_register, upsert_buckets, upsert_employee_buckets, upsert_employees
from rollcall.plans.employees import merge_employees
from rollcall.sinks import read_days, read_table
from rollcall.sources import keyed_scan, land_by_key
from tests.conftest import land
from tests.test_plans import DEVICES, _att, _emp


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_keyed_scan_prunes_buckets_and_equals_the_lookup(spark, tmp_path):
    dim = spark.range(5000).select(F.nullif(F.col("id"), F.lit(7)).cast("string").alias("device_id"), F.col("id").alias("v"))
    path = str(tmp_path / "dim")
    land_by_key(dim, path, "device_id", 32)
    land_by_key(dim, path, "device_id", 32)                                 # replaced, not doubled
    keys = spark.createDataFrame([("12",), ("4000",), (None,), ("none",)], "k string")
    got = keyed_scan(spark, path, "device_id", keys, 32)
    assert _rows(got) == _rows(lookup_keys(dim, "device_id", keys)) and got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    rows = got.collect()
    assert len(rows) == 3
    empty = keyed_scan(spark, path, "device_id", keys.limit(0), 32)
    assert empty.count() == 0


def test_attendance_load_from_bucketed_devices(spark, landing, warehouse):
    land(landing, "devices", "detailsbydeviceid", DEVICES)
    land_by_key(spark.createDataFrame(DEVICES, "device_id string, org_id string, entry_name string, org_name string"),
                f"{landing}/devices_by_key", "device_id", 8)
    land(landing, "attendance", "successattendance",
         [_att("a", "g1", "e1"), _att("b", "dd", ""), _att("c", None, "zz")], day="2024-01-05")
    load_attendance(spark, str(landing), f"{warehouse}/plain")
    load_attendance(spark, str(landing), f"{warehouse}/keyed", device_buckets=8)
    assert _rows(read_days(spark, f"{warehouse}/keyed/attendance")) == _rows(read_days(spark, f"{warehouse}/plain/attendance"))


def _files(warehouse):
    return {os.path.dirname(f).rpartition("=")[2]: f for f in glob.glob(f"{warehouse}/employee_by_key/of-16/bucket=*/*.parquet")}


def test_register_rewrites_only_the_buckets_of_the_feed(spark, landing, warehouse):
    land(landing, "employee", "employee", [_emp(str(i), f"name {i}", "TUTOR") for i in range(200)])
    assert len(upsert_employee_buckets(spark, str(landing), warehouse, buckets=16)) == 16
    upsert_employees(spark, str(landing), warehouse)
    before = _files(warehouse)
    os.unlink(f"{landing}/employee/page-0.json")
    land(landing, "employee", "employee", [_emp("5", "changed", "PROFESSOR"), _emp("new", "x", "y"), _emp("5", "second", "z"),
                                           _emp(None, "no id", "a"), _emp("9", None, "dropped")])
    touched = upsert_employee_buckets(spark, str(landing), warehouse, buckets=16)
    assert 1 <= len(touched) <= 3
    after = _files(warehouse)
    assert {b for b in after if after[b] != before.get(b)} == {str(b) for b in touched}
    upsert_employees(spark, str(landing), warehouse)
    got = read_register(spark, warehouse, 16).drop("bucket")
    whole = read_table(spark, warehouse, "employee")
    assert _rows(got.select(*whole.columns)) == _rows(whole)
    assert upsert_employee_buckets(spark, str(landing), warehouse, buckets=16) == touched      # again: the same register
    assert _rows(read_register(spark, warehouse, 16).drop("bucket").select(*whole.columns)) == _rows(whole)


def test_register_columns_stay_equal_in_all_buckets(spark, warehouse):
    def feed(rows, ddl):
        return spark.createDataFrame(rows, ddl).withColumns({"_file": F.lit("p-0.json"), "_pos": F.lit(0)})

    upsert_buckets(feed([(str(i), "a") for i in range(50)], "emp_id string, n string"), warehouse, buckets=8)
    old = read_register(spark, warehouse, 8).drop("bucket").collect()
    new = feed([("3", "b", 1)], "emp_id string, n string, extra long")
    upsert_buckets(new, warehouse, buckets=8)
    got = read_register(spark, warehouse, 8).drop("bucket")
    want = merge_employees(new, spark.createDataFrame(old))
    assert _rows(got.select("emp_id", "n", "extra")) == _rows(want.select("emp_id", "n", "extra"))
    with pytest.raises(SchemaClash):
        upsert_buckets(feed([("3", 1)], "emp_id string, n long"), warehouse, buckets=8)
    assert upsert_buckets(new.limit(0), warehouse, buckets=8) == [] and read_register(spark, f"{warehouse}/none") is None
