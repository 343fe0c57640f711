"""The loads on hand-made landing zones (edge rows from FIXTURES.md)."""

import datetime as dt

from rollcall.plans import (
    latest_loaded_date, load_attendance, refresh_leave, replace_holidays, upsert_employees,
)
from rollcall.sinks import current_version, read_days, read_table
from tests.conftest import land

DAY1, DAY2 = "2024-01-05", "2024-01-06"

DEVICES = [
    {"device_id": "g1", "org_id": "000046", "entry_name": "Gate A-wing", "org_name": "MAIN"},
    {"device_id": "e1", "org_id": "000051", "entry_name": "x", "org_name": "ENT/EYE (OLD)"},
    {"device_id": "n1", "org_id": None, "entry_name": "y", "org_name": "Z"},
    {"device_id": "dd", "org_id": "000051", "entry_name": "x", "org_name": "TWICE ONE"},
    {"device_id": "dd", "org_id": "000051", "entry_name": "x", "org_name": "TWICE TWO"},
]


def _att(emp, i, o, day=DAY1):
    return {"emp_id": emp, "log_date": day, "in_device_id": i, "out_device_id": o}


def _land_attendance(landing):
    land(landing, "devices", "detailsbydeviceid", DEVICES)
    land(landing, "attendance", "successattendance", [
        _att("both", "g1", "e1"), _att("noout", "e1", ""), _att("nullin", None, "g1"),
        _att("unknown", "zz", "n1"), _att("dup", "dd", "dd")], day=DAY1)


def _rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_attendance_load_edge_rows(spark, landing, warehouse):
    _land_attendance(landing)
    status = load_attendance(spark, str(landing), warehouse)
    assert status.loaded
    got = _rows(read_days(spark, f"{warehouse}/attendance"), "emp_id", "in_location", "out_location")
    assert ("both", "Gate A-wing", "Ent/Eye (Old)") in got
    assert ("noout", "Ent/Eye (Old)", None) in got
    assert ("nullin", None, "Gate A-wing") in got
    assert ("unknown", None, None) in got                      # unknown id; null org_id
    assert len([g for g in got if g[0] == "dup"]) == 4         # twice in both roles
    assert len(got) == 8


def test_attendance_rerun_and_high_water_mark(spark, landing, warehouse):
    _land_attendance(landing)
    load_attendance(spark, str(landing), warehouse)
    again = load_attendance(spark, str(landing), warehouse)
    assert not again.loaded and again.message == "No New Attendance Data"
    land(landing, "attendance", "successattendance", [_att("next", "g1", "g1", DAY2)], day=DAY2)
    status = load_attendance(spark, str(landing), warehouse)
    assert status.loaded and status.from_day == dt.date(2024, 1, 6)
    assert status.message == "Attendance Updated for 06 Jan 2024"
    table = read_days(spark, f"{warehouse}/attendance")
    assert table.count() == 9
    assert latest_loaded_date(spark, warehouse).first()["last_date"] == dt.date(2024, 1, 6)
    assert latest_loaded_date(spark, warehouse, use_marks=False).first()["last_date"] == dt.date(2024, 1, 6)


def test_attendance_empty_day_writes_nothing(spark, landing, warehouse):
    land(landing, "devices", "detailsbydeviceid", DEVICES)
    land(landing, "attendance", "successattendance", [], day=DAY1)
    status = load_attendance(spark, str(landing), warehouse)
    assert not status.loaded
    assert read_days(spark, f"{warehouse}/attendance") is None


def test_attendance_restrict_devices_same_result(spark, landing, tmp_path):
    _land_attendance(landing)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    load_attendance(spark, str(landing), a)
    load_attendance(spark, str(landing), b, restrict_devices=True)
    cols = ("emp_id", "in_location", "out_location")
    assert _rows(read_days(spark, f"{a}/attendance"), *cols) == _rows(read_days(spark, f"{b}/attendance"), *cols)


def test_latest_date_null_first_but_mark_ignores_it(spark, landing, warehouse):
    land(landing, "devices", "detailsbydeviceid", DEVICES)
    land(landing, "attendance", "successattendance", [_att("a", "g1", "g1"), _att("b", "g1", "g1", None)],
         day=DAY1)
    load_attendance(spark, str(landing), warehouse)
    assert latest_loaded_date(spark, warehouse).first()["last_date"] is None
    assert latest_loaded_date(spark, warehouse, use_marks=False).first()["last_date"] is None
    from rollcall.operators import next_load_date
    from rollcall.plans import next_attendance_day
    assert next_load_date(read_days(spark, f"{warehouse}/attendance")).first()[0] == dt.date(2024, 1, 6)
    assert next_attendance_day(spark, warehouse) == dt.date(2024, 1, 6)
    # the day is reloaded with the missing date fixed: its mark is replaced
    land(landing, "attendance", "successattendance", [_att("a", "g1", "g1"), _att("b", "g1", "g1")],
         day=DAY1)
    from rollcall.sinks import append_day, refresh_marks
    from rollcall.sources import read_envelope
    from rollcall import schemas
    att = read_envelope(spark, f"{landing}/attendance", schemas.ROOT_ATTENDANCE, schemas.ATTENDANCE,
                        dated=True).drop("_file", "_pos")
    append_day(att, f"{warehouse}/attendance")
    refresh_marks(spark, f"{warehouse}/attendance", dt.date(2024, 1, 5))
    assert latest_loaded_date(spark, warehouse).first()["last_date"] == dt.date(2024, 1, 5)


def _leave(emp, status, reason="r", extra="e", lt="CL"):
    r = {"emp_id": emp, "active_status": status, "reason": reason, "created_by": "hr",
         "creation_date": "2024-01-01", "note": extra}
    if lt is not None:
        r["leave_type"] = lt
    return r


def test_leave_refresh_edge_rows(spark, landing, warehouse):
    land(landing, "leave", "leavedetails",
         [_leave("y", "Y"), _leave("n", "N"), _leave("null", None), _leave("y", "Y"),
          _leave("y", "Y", extra="other")], day="2024-01-01")
    land(landing, "leave", "leavedetails", [_leave("y", "Y")], day="2024-01-02")
    land(landing, "leave", "leavedetails", [], day="2024-01-03")
    land(landing, "tour", "tourdetails", [_leave("t", "Y", lt=None)], day="2024-01-02")
    land(landing, "leave", "leavedetails", [_leave("late", "Y")], day="2024-02-01")
    refresh_leave(spark, str(landing), warehouse, stop="2024-01-31")
    out = read_table(spark, warehouse, "leave")
    assert out.columns == ["date", "emp_id", "leave_type", "reason", "created_by", "creation_date"]
    got = _rows(out, "date", "emp_id", "leave_type")
    assert got == sorted([(dt.date(2024, 1, 1), "y", "CL"), (dt.date(2024, 1, 2), "y", "CL"),
                          (dt.date(2024, 1, 2), "t", None)], key=repr)
    refresh_leave(spark, str(landing), warehouse, stop="2024-01-31")      # twice = once
    assert current_version(spark, warehouse, "leave") == 2
    assert read_table(spark, warehouse, "leave").count() == 3


def _emp(i, name, des, div="GENERAL MEDICINE"):
    return {"emp_id": i, "emp_name": name, "designation": des, "division": div}


def test_employee_upsert_edge_rows(spark, landing, warehouse):
    old = spark.createDataFrame(
        [("keep", "OLD NAME", "CLERK", "X", "Other"), ("nullname", "Old Person", "Tutor", "Y", "Junior Resident"),
         ("both", "Was", "Tutor", "Old Div", "Junior Resident")],
        "emp_id string, emp_name string, designation string, division string, cat string")
    from rollcall.sinks import replace_table
    replace_table(old, warehouse, "employee")
    land(landing, "employee", "employee", [
        _emp("jr", "ravi kumar", "JUNIOR RESIDENT NG"),
        _emp("tut", "a", "TUTOR NG NG"),
        _emp("nodes", "b", None), _emp("clerk", "c", "CLERK"),
        _emp("ap", "d", "ASSISTANT PROFESSOR"), _emp("st", "d", "STATISTICIAN"),
        _emp("asp", "d", "ASSOCIATE PROFESSOR"), _emp("p", "d", "PROFESSOR"),
        _emp("t", "d", "TUTOR"), _emp("sr", "d", "SENIOR RESIDENT"),
        _emp("twice", "first", "TUTOR"), _emp("twice", "second", "PROFESSOR"),
        _emp("nullname", None, "PROFESSOR"),
        _emp("both", "now", "PROFESSOR", None),
        _emp(None, "null one", "TUTOR"), _emp(None, "null two", "TUTOR"),
    ])
    upsert_employees(spark, str(landing), warehouse)
    out = read_table(spark, warehouse, "employee")
    by_id = {r["emp_id"]: r for r in out.collect()}
    assert len(by_id) == out.count()                               # unique per id
    assert (by_id["jr"]["designation"], by_id["jr"]["cat"], by_id["jr"]["emp_name"]) == \
        ("Junior Resident", "Junior Resident", "Ravi Kumar")
    assert (by_id["tut"]["designation"], by_id["tut"]["cat"]) == ("Tutor Ng", "Other")
    assert by_id["nodes"]["cat"] == "Other" and by_id["clerk"]["cat"] == "Other"
    for i in ("ap", "st", "asp", "p"):
        assert by_id[i]["cat"] == "Faculty"
    assert by_id["t"]["cat"] == "Junior Resident" and by_id["sr"]["cat"] == "Senior Resident"
    assert by_id["twice"]["emp_name"] == "First"
    assert by_id["nullname"]["emp_name"] == "Old Person"          # new row without a name dropped
    assert (by_id["both"]["emp_name"], by_id["both"]["division"]) == ("Now", None)
    assert by_id["keep"]["emp_name"] == "OLD NAME"                # not re-normalised
    assert by_id[None]["emp_name"] == "Null One"
    # the same feed again changes nothing
    upsert_employees(spark, str(landing), warehouse)
    again = read_table(spark, warehouse, "employee")
    cols = out.columns
    assert _rows(again, *cols) == _rows(out, *cols)


def test_holiday_replace(spark, landing, warehouse):
    land(landing, "holiday", "holiday", [{"holiday_date": "2024-01-26", "holiday_name": "Republic Day"}])
    replace_holidays(spark, str(landing), warehouse)
    land(landing, "holiday", "holiday", [{"holiday_date": "2024-08-15", "holiday_name": "Independence Day"},
                                         {"holiday_date": "2024-10-02", "holiday_name": "Gandhi Jayanti"}])
    replace_holidays(spark, str(landing), warehouse)
    out = read_table(spark, warehouse, "holiday")
    assert sorted(r["holiday_name"] for r in out.collect()) == ["Gandhi Jayanti", "Independence Day"]
    assert "_file" not in out.columns


def test_table_without_marks_is_loaded_again_unless_adopted(spark, landing, warehouse):
    from rollcall.plans import adopt_table, next_attendance_day
    from rollcall.sinks import append_day, read_marks
    old = spark.createDataFrame([("x", "2024-01-09", "g1", "g1", dt.date(2024, 1, 2))],
                                "emp_id string, log_date string, in_device_id string, "
                                "out_device_id string, reportdate date")
    append_day(old, f"{warehouse}/attendance")                    # days without a record of their load
    assert read_marks(spark, f"{warehouse}/attendance") is None
    assert next_attendance_day(spark, warehouse) is None
    assert next_attendance_day(spark, warehouse, "2024-01-01") == dt.date(2024, 1, 1)
    adopt_table(spark, warehouse)
    assert next_attendance_day(spark, warehouse) == dt.date(2024, 1, 10)
    assert read_marks(spark, f"{warehouse}/attendance").count() == 1


def test_empty_leave_history_replaces_with_typed_empty_table(spark, landing, warehouse):
    land(landing, "leave", "leavedetails", [_leave("n", "N")], day="2024-01-01")
    land(landing, "tour", "tourdetails", [], day="2024-01-01")
    refresh_leave(spark, str(landing), warehouse, stop="2024-01-31")
    out = read_table(spark, warehouse, "leave")
    assert out.count() == 0
    assert out.schema["date"].dataType.simpleString() == "date"
    assert out.columns == ["date", "emp_id", "leave_type", "reason", "created_by", "creation_date"]


def test_leave_window_equals_full_rebuild(spark, landing, tmp_path):
    for day, emps in (("2024-01-01", ["a", "b"]), ("2024-01-02", ["a"]), ("2024-01-03", ["c"])):
        land(landing, "leave", "leavedetails", [_leave(e, "Y") for e in emps], day=day)
        land(landing, "tour", "tourdetails", [_leave(e + "t", "Y", lt=None) for e in emps], day=day)
    full, win = str(tmp_path / "full"), str(tmp_path / "win")
    refresh_leave(spark, str(landing), win, stop="2024-01-02")          # yesterday's run
    land(landing, "leave", "leavedetails", [_leave("d", "Y")], day="2024-01-04")
    refresh_leave(spark, str(landing), full, stop="2024-01-04")
    refresh_leave(spark, str(landing), win, stop="2024-01-04", since="2024-01-02")
    cols = ["date", "emp_id", "leave_type", "reason", "created_by", "creation_date"]
    assert _rows(read_table(spark, win, "leave"), *cols) == _rows(read_table(spark, full, "leave"), *cols)
    assert read_table(spark, win, "leave").count() == 9


def test_holiday_replace_twice_equals_once(spark, landing, warehouse):
    land(landing, "holiday", "holiday", [{"holiday_date": "2024-01-26", "holiday_name": "R"},
                                         {"holiday_date": "2024-01-26", "holiday_name": "R"}])
    replace_holidays(spark, str(landing), warehouse)
    once = _rows(read_table(spark, warehouse, "holiday"), "holiday_date", "holiday_name")
    replace_holidays(spark, str(landing), warehouse)
    twice = _rows(read_table(spark, warehouse, "holiday"), "holiday_date", "holiday_name")
    assert once == twice and len(once) == 2            # passed through unchanged, duplicates kept
