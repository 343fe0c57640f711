from rollcall.daily import run
from tests.conftest import land
from tests.test_plans import DEVICES, _att, _emp, _leave


def test_daily_run_all_loads_and_rerun(spark, landing, warehouse):
    land(landing, "devices", "detailsbydeviceid", DEVICES)
    land(landing, "attendance", "successattendance", [_att("a", "g1", "e1")], day="2024-01-05")
    land(landing, "leave", "leavedetails", [_leave("y", "Y")], day="2024-01-02")
    land(landing, "tour", "tourdetails", [], day="2024-01-02")
    land(landing, "employee", "employee", [_emp("1", "x", "TUTOR")])
    land(landing, "holiday", "holiday", [{"holiday_date": "2024-01-26", "holiday_name": "R"}])
    first = run(spark, str(landing), warehouse)
    assert first["attendance"] == "Attendance Updated for all landed days"
    assert first["latest_date"] == "2024-01-05"
    assert all(not v.startswith("FAILED") for v in first.values())
    again = run(spark, str(landing), warehouse)
    assert again["attendance"] == "No New Attendance Data"
    from rollcall.plans import read_leave
    from rollcall.sinks import read_days, read_table
    assert read_days(spark, f"{warehouse}/attendance").count() == 1
    assert read_leave(spark, warehouse).count() == 1
    assert read_table(spark, warehouse, "employee").count() == 1


def test_daily_run_keeps_going_after_a_failure(spark, landing, warehouse):
    land(landing, "holiday", None, None, raw='{"holiday": [ {')          # malformed
    land(landing, "employee", "employee", [_emp("1", "x", "TUTOR")])
    out = run(spark, str(landing), warehouse, only=["holiday", "employee"])
    assert out["holiday"].startswith("FAILED")
    assert out["employee"].startswith("Employee register updated")


def test_daily_run_on_json_lines_landing(spark, landing, warehouse):
    import json
    land(landing, "devices", None, None, raw=json.dumps({"detailsbydeviceid": DEVICES[:2]}) + "\n"
         + json.dumps({"detailsbydeviceid": DEVICES[2:]}) + "\n")
    land(landing, "attendance", None, None, day="2024-01-05",
         raw=json.dumps({"successattendance": [_att("a", "g1", "e1")]}) + "\n"
         + json.dumps({"successattendance": [_att("b", "dd", "")]}) + "\n")
    out = run(spark, str(landing), warehouse, only=["attendance"], multi_line=False)
    assert out["attendance"].startswith("Attendance Updated")
    from rollcall.sinks import read_days
    got = sorted((r["emp_id"], r["in_location"]) for r in read_days(spark, f"{warehouse}/attendance").collect())
    assert got == [("a", "Gate A-wing"), ("b", "Twice One"), ("b", "Twice Two")]


def test_cli_main_exit_codes(spark, landing, warehouse, capsys):
    from rollcall.daily import main
    land(landing, "holiday", "holiday", [{"holiday_date": "2024-01-26", "holiday_name": "R"}])
    assert main(["--landing", str(landing), "--warehouse", warehouse, "--only", "holiday", "--local"]) == 0
    assert "holiday: Holidays replaced (version 1)" in capsys.readouterr().out
    assert main(["--landing", str(landing), "--warehouse", warehouse, "--only", "employee", "--local"]) == 1
