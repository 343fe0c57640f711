"""The loads over several runs: gaps, restarts, late pages, odd payloads, what is listed."""

import datetime as dt

import pytest

from rollcall import schemas
from rollcall.daily import run
from rollcall.operators import has_rows
from rollcall.plans import covered_days, load_attendance, next_attendance_day, read_leave, refresh_leave, upsert_employees
from rollcall.sinks import append_day, current_version, drop_old_versions, read_days, read_table, replace_table
from rollcall.sources import (
    day_folders, explode_envelope, not_landed, read_envelope, read_records, request_manifest,
)
from tests.conftest import land
from tests.test_plans import DEVICES, _att, _emp, _leave


def _leave_days(landing, *days):
    for d in days:
        land(landing, "leave", "leavedetails", [_leave(f"e{d}", "Y")], day=f"2024-01-{d:02d}")
        land(landing, "tour", "tourdetails", [], day=f"2024-01-{d:02d}")


def _stored_leave(spark, warehouse):
    return sorted(r["date"].day for r in read_leave(spark, warehouse).collect())


def test_window_on_a_fresh_store_rebuilds_in_full(spark, landing, warehouse):
    _leave_days(landing, *range(1, 11))
    refresh_leave(spark, str(landing), warehouse, stop=None, since="2024-01-08")
    assert _stored_leave(spark, warehouse) == list(range(1, 11))
    assert covered_days(spark, warehouse) == (dt.date(2024, 1, 1), dt.date(2024, 1, 10))


def test_window_after_missed_runs_reads_the_days_between(spark, landing, warehouse):
    _leave_days(landing, *range(1, 11))
    refresh_leave(spark, str(landing), warehouse, stop="2024-01-03")
    refresh_leave(spark, str(landing), warehouse, stop="2024-01-10", since="2024-01-08")
    assert _stored_leave(spark, warehouse) == list(range(1, 11))
    refresh_leave(spark, str(landing), warehouse, start="2024-01-05", stop="2024-01-10", since="2024-01-08")
    assert _stored_leave(spark, warehouse) == list(range(5, 11))           # another start: full


def test_leave_stops_at_the_day_fixed_before_the_append(spark, landing, warehouse):
    land(landing, "devices", "detailsbydeviceid", DEVICES)
    land(landing, "attendance", "successattendance", [_att("a", "g1", "e1", "2024-01-05")], day="2024-01-05")
    _leave_days(landing, 5, 6)
    run(spark, str(landing), warehouse, first_day="2024-01-05", only=["attendance", "leave"])
    assert _stored_leave(spark, warehouse) == [5]
    run(spark, str(landing), warehouse, only=["attendance", "leave"], leave_window_days=0)
    assert _stored_leave(spark, warehouse) == [5, 6]


def test_restart_after_part_of_a_first_load(spark, landing, warehouse):
    land(landing, "devices", "detailsbydeviceid", DEVICES)
    for d in ("2024-01-05", "2024-01-06", "2024-01-07"):
        land(landing, "attendance", "successattendance", [_att(d, "g1", "e1", d)], day=d)
    load_attendance(spark, str(landing), f"{warehouse}/whole")
    last = read_days(spark, f"{warehouse}/whole/attendance").filter("reportdate = date'2024-01-07'")
    append_day(last, f"{warehouse}/attendance")                            # what a crash left, no marks
    load_attendance(spark, str(landing), warehouse)
    assert read_days(spark, f"{warehouse}/attendance").count() == 3
    assert next_attendance_day(spark, warehouse) == dt.date(2024, 1, 8)


def test_blank_device_id_gets_no_location(spark, landing, warehouse):
    land(landing, "devices", "detailsbydeviceid", DEVICES + [
        {"device_id": "", "org_id": "000051", "entry_name": "x", "org_name": "BLANK"}])
    land(landing, "attendance", "successattendance", [_att("a", "g1", "")], day="2024-01-05")
    for restrict in (False, True):
        load_attendance(spark, str(landing), f"{warehouse}/{restrict}", restrict_devices=restrict)
        row = read_days(spark, f"{warehouse}/{restrict}/attendance").first()
        assert (row["in_location"], row["out_location"]) == ("Gate A-wing", None)


def test_pages_are_ordered_by_number(spark, landing, warehouse):
    land(landing, "employee", "employee", [_emp("1", "from ten", "TUTOR")], name="page-10.json")
    land(landing, "employee", "employee", [_emp("1", "from two", "TUTOR")], name="page-2.json")
    upsert_employees(spark, str(landing), warehouse)
    assert read_table(spark, warehouse, "employee").first()["emp_name"] == "From Two"


def test_malformed_text_fails_and_bare_arrays_are_read(spark, landing):
    bad = spark.createDataFrame([('{"holiday": [ {',)], "body string")
    with pytest.raises(Exception):
        explode_envelope(bad, "body", "holiday", schemas.HOLIDAY).collect()
    land(landing, "bare", None, None, raw='[{"holiday_date": "a"},\n {"holiday_name": "b"}]')
    got = read_records(spark, f"{landing}/bare", schemas.HOLIDAY).orderBy("_pos").collect()
    assert [(r["holiday_date"], r["holiday_name"]) for r in got] == [("a", None), (None, "b")]
    land(landing, "none", None, None, raw="[]")
    assert read_records(spark, f"{landing}/none", schemas.HOLIDAY).count() == 0


def test_only_the_day_folders_of_the_load_are_listed(spark, landing):
    for d in range(1, 29):
        land(landing, "leave", "leavedetails", [_leave("x", "Y")], day=f"2024-01-{d:02d}")
    path = f"{landing}/leave"
    assert len(day_folders(spark, path, dt.date(2024, 1, 27), None)) == 2
    df = read_envelope(spark, path, "leavedetails", schemas.LEAVE, dated=True, first_day=dt.date(2024, 1, 27))
    assert len(df.inputFiles()) == 2 and df.count() == 2
    none = read_envelope(spark, path, "leavedetails", schemas.LEAVE, dated=True, first_day=dt.date(2025, 1, 1))
    assert none.count() == 0 and set(none.columns) == set(df.columns)


def test_old_versions_are_dropped(spark, warehouse):
    for i in range(5):
        replace_table(spark.range(i), warehouse, "t")
    assert drop_old_versions(spark, warehouse, "t", 2) == [1, 2, 3]
    assert current_version(spark, warehouse, "t") == 5 and read_table(spark, warehouse, "t").count() == 4
    assert drop_old_versions(spark, warehouse, "missing", 2) == []
    with pytest.raises(ValueError):
        drop_old_versions(spark, warehouse, "t", 0)


def test_manifest_lists_pages(spark):
    keys = spark.createDataFrame([("a", 2500), ("b", 0), ("c", None), ("d", 1000)], "k string, total long")
    m = request_manifest(keys, "f", key_col="k", total_col="total")
    got = sorted(r["path"] or "" for r in m.collect())
    assert got == ["", "f/key=a/offset=0/count=1000", "f/key=a/offset=1000/count=1000",
                   "f/key=a/offset=2000/count=1000", "f/key=b/offset=0/count=1000", "f/key=d/offset=0/count=1000"]
    landed = spark.createDataFrame([("f/key=a/offset=0/count=1000",)], "path string")
    assert not_landed(m.filter("path like '%key=a%'"), landed).count() == 2


def test_has_rows_is_a_constant(spark):
    df = has_rows(spark.range(5).filter("id > 3"))
    assert df.first()["has_rows"] is True and has_rows(spark.range(0)).first()["has_rows"] is False


def test_scratch_folders_are_dropped_on_request(spark):
    import os

    from rollcall.session import drop_scratch, scratch_path
    path = scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    assert drop_scratch(spark) >= 1 and not os.path.exists(path.removeprefix("file:"))
    assert drop_scratch(spark) == 0
