import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.sources import not_landed, read_envelope, request_manifest
from tests.conftest import land


def test_envelope_rows_positions_and_file(spark, landing):
    land(landing, "employee", "employee", [{"emp_id": "1", "emp_name": "A"}, {"emp_id": "2"}])
    df = read_envelope(spark, f"{landing}/employee", "employee", schemas.EMPLOYEE)
    got = sorted((r["emp_id"], r["_pos"], r["emp_name"]) for r in df.collect())
    assert got == [("1", 0, "A"), ("2", 1, None)]
    assert df.first()["_file"].endswith("page-0.json")


def test_envelope_empty_and_absent_root_give_no_rows(spark, landing):
    land(landing, "attendance", "successattendance", [], day="2024-01-02")
    land(landing, "attendance", None, None, day="2024-01-03", raw='{"other": [1, 2]}')
    df = read_envelope(spark, f"{landing}/attendance", "successattendance", schemas.ATTENDANCE, dated=True)
    assert df.count() == 0
    assert set(schemas.ATTENDANCE.fieldNames()) <= set(df.columns)


def test_envelope_keeps_zero_padded_ids_as_text(spark, landing):
    land(landing, "devices", "detailsbydeviceid", [{"device_id": "7", "org_id": "000046"}])
    df = read_envelope(spark, f"{landing}/devices", "detailsbydeviceid", schemas.DEVICES)
    assert df.first()["org_id"] == "000046"


def test_dated_envelope_prunes_partitions(spark, landing):
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        land(landing, "attendance", "successattendance", [{"emp_id": day}], day=day)
    df = read_envelope(spark, f"{landing}/attendance", "successattendance", schemas.ATTENDANCE, dated=True)
    recent = df.filter(F.col("reportdate") >= F.lit("2024-01-02").cast("date"))
    assert sorted(r["emp_id"] for r in recent.collect()) == ["2024-01-02", "2024-01-03"]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(reportdate" in plan


def test_malformed_payload_fails_loudly(spark, landing):
    land(landing, "holiday", None, None, raw='{"holiday": [ {"a": ')
    df = read_envelope(spark, f"{landing}/holiday", "holiday", schemas.HOLIDAY)
    with pytest.raises((PySparkException, Py4JJavaError)):
        df.collect()


def test_manifest_and_not_landed(spark):
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), (None,)], "d string") \
        .select(F.col("d").cast("date").alias("d"))
    m = request_manifest(days, "leave", day_col="d")
    assert sorted(r[0] for r in m.collect() if r[0]) == ["leave/reportdate=2024-01-01",
                                                         "leave/reportdate=2024-01-02"]
    assert any(r[0] is None for r in m.collect())            # no "NA" in a path
    landed = spark.createDataFrame([("leave/reportdate=2024-01-01",)], "path string")
    assert [r[0] for r in not_landed(m.dropna(), landed).collect()] == ["leave/reportdate=2024-01-02"]


def test_device_request_manifest_from_both_roles(spark):
    from rollcall.plans import device_keys
    att = spark.createDataFrame([("a", "d1", ""), ("b", None, "d2"), ("c", "d1", "d2")],
                                "emp_id string, in_device_id string, out_device_id string")
    m = request_manifest(device_keys(att), "devices", key_col="device_id", key_name="deviceid")
    got = sorted((r[0] for r in m.collect()), key=lambda v: (v is not None, v))
    assert got == [None, "devices/deviceid=d1", "devices/deviceid=d2"]
