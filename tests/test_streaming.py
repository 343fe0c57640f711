import datetime as dt
import os
import time

import pytest

from rollcall.plans import latest_loaded_date, load_attendance
from rollcall.sinks import current_version, read_days, read_marks
from rollcall.streaming import run_attendance_stream
from tests.conftest import land
from tests.test_plans import DEVICES, _att


def _day(landing, day, *emps, page="page-0.json", dev="g1"):
    land(landing, "attendance", "successattendance", [_att(e, dev, "e1", day) for e in emps], day=day, name=page)


def _stored(spark, warehouse):
    return sorted(r["emp_id"] for r in read_days(spark, f"{warehouse}/attendance").collect())


def test_batch_stream_batch_on_one_table(spark, landing, warehouse, tmp_path):
    ckpt = str(tmp_path / "ckpt")
    land(landing, "devices", "detailsbydeviceid", DEVICES)
    _day(landing, "2024-01-05", "a")
    load_attendance(spark, str(landing), warehouse)
    _day(landing, "2024-01-06", "b")
    run_attendance_stream(spark, str(landing), warehouse, ckpt)
    _day(landing, "2024-01-07", "c")
    load_attendance(spark, str(landing), warehouse)
    assert _stored(spark, warehouse) == ["a", "b", "c"]
    run_attendance_stream(spark, str(landing), warehouse, ckpt)
    assert _stored(spark, warehouse) == ["a", "b", "c"]
    before = current_version(spark, warehouse, "attendance_marks")
    run_attendance_stream(spark, str(landing), warehouse, ckpt)             # nothing new
    assert current_version(spark, warehouse, "attendance_marks") == before


def test_late_old_and_corrected_pages_appear(spark, landing, warehouse, tmp_path):
    ckpt = str(tmp_path / "ckpt")
    land(landing, "devices", "detailsbydeviceid", DEVICES)
    _day(landing, "2024-01-05", "a")
    _day(landing, "2024-01-07", "z")
    run_attendance_stream(spark, str(landing), warehouse, ckpt)
    _day(landing, "2024-01-05", "b", page="page-1.json")
    folder = os.path.join(str(landing), "attendance", "reportdate=2024-01-05")
    old = time.time() - 30 * 86400
    os.utime(os.path.join(folder, "page-1.json"), (old, old))               # landed now, dated long ago
    run_attendance_stream(spark, str(landing), warehouse, ckpt)
    assert _stored(spark, warehouse) == ["a", "b", "z"]
    os.unlink(os.path.join(folder, "page-0.json"))
    _day(landing, "2024-01-05", "c", page="page-2.json")                    # page 0 withdrawn, page 2 new
    run_attendance_stream(spark, str(landing), warehouse, ckpt)
    assert _stored(spark, warehouse) == ["b", "c", "z"]
    marks = {r["reportdate"]: r["rows"] for r in read_marks(spark, f"{warehouse}/attendance").collect()}
    assert marks == {dt.date(2024, 1, 5): 2, dt.date(2024, 1, 7): 1}
    assert latest_loaded_date(spark, warehouse).first()["last_date"] == dt.date(2024, 1, 7)


def test_failed_stream_run_keeps_the_days_it_finished(spark, landing, warehouse, tmp_path):
    land(landing, "devices", "detailsbydeviceid", DEVICES)
    _day(landing, "2024-01-05", "a")
    bad = land(landing, "attendance", None, None, day="2024-01-06", raw='{"successattendance": [ {')
    later = time.time() + 5
    os.utime(os.path.join(bad, "page-0.json"), (later, later))              # processed after the good page
    with pytest.raises(Exception):
        run_attendance_stream(spark, str(landing), warehouse, str(tmp_path / "ckpt"), max_files_per_trigger=1)
    marks = {r["reportdate"]: r["rows"] for r in read_marks(spark, f"{warehouse}/attendance").collect()}
    assert marks == {dt.date(2024, 1, 5): 1} and _stored(spark, warehouse) == ["a"]


def test_salting_a_stream_is_refused(spark):
    from rollcall.operators import role_join
    stream = spark.readStream.format("rate").load().selectExpr("cast(value as string) as in_device_id")
    dev = spark.createDataFrame([("g1", "Gate")], "device_id string, loc string")
    with pytest.raises(ValueError):
        role_join(stream, dev, {"in_device_id": "x"}, "device_id", "loc", broadcast=False, salt_buckets=4)
