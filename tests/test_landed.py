"""Late pages, incomplete days, misdated rows, changed leave days and day-wise schemas."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.daily import run
from rollcall.operators import SchemaClash
from rollcall.plans import (
    adopt_table, latest_loaded_date, leave_history, load_attendance, read_leave, refresh_leave, refresh_leave_days,
)
from rollcall.plans.attendance import load_days
from rollcall.sinks import append_day, drop_days, read_days, read_marks, read_table, refresh_marks, rewrite_days
from rollcall.sinks.marks import day_states
from rollcall.sources import (
    completeness, landed_days, landed_files, page_number, paged_manifest, request_manifest,
)
from tests.conftest import land
from tests.test_plans import DEVICES, _att, _leave

D = [None, *(dt.date(2024, 1, k) for k in range(1, 29))]


def _day(landing, day, *emps, page=0, dated=None):
    land(landing, "attendance", "successattendance", [_att(e, "g1", "e1", dated or str(day)) for e in emps], day=day,
         name=f"page-{page}.json")


@pytest.fixture
def zone(landing):
    land(landing, "devices", "detailsbydeviceid", DEVICES)
    return str(landing)


def _stored(spark, warehouse):
    return sorted(r["emp_id"] for r in read_days(spark, f"{warehouse}/attendance").collect())


def test_late_page_of_a_loaded_day_is_loaded_by_the_batch(spark, zone, warehouse):
    _day(zone, D[5], "a")
    _day(zone, D[6], "z")
    assert load_attendance(spark, zone, warehouse).days == [D[5], D[6]]
    before = set(read_days(spark, f"{warehouse}/attendance", days=[D[6]]).inputFiles())
    _day(zone, D[5], "b", page=1)
    status = load_attendance(spark, zone, warehouse)
    assert status.late == status.days == [D[5]] and "2024-01-05" in status.message and not status.stalled
    assert _stored(spark, warehouse) == ["a", "b", "z"]
    assert set(read_days(spark, f"{warehouse}/attendance", days=[D[6]]).inputFiles()) == before    # left alone
    assert load_attendance(spark, zone, warehouse).message == "No New Attendance Data"


def test_withdrawn_and_emptied_days(spark, zone, warehouse):
    _day(zone, D[5], "a")
    _day(zone, D[5], "b", page=1)
    _day(zone, D[6], "c")
    load_attendance(spark, zone, warehouse)
    os.unlink(f"{zone}/attendance/reportdate=2024-01-05/page-1.json")
    _day(zone, D[6], page=0)                                        # corrected to an empty payload
    assert load_attendance(spark, zone, warehouse).late == [D[5], D[6]]
    assert _stored(spark, warehouse) == ["a"]
    marks = {r["reportdate"]: r["rows"] for r in read_marks(spark, f"{warehouse}/attendance").collect()}
    assert marks == {D[5]: 1, D[6]: 0}
    assert load_attendance(spark, zone, warehouse).days == []       # the empty day counts as read
    assert latest_loaded_date(spark, warehouse).first()[0] == D[5]


def test_whole_day_that_lands_late_is_loaded_and_earlier_days_are_not(spark, zone, warehouse):
    _day(zone, D[4], "before")
    _day(zone, D[5], "a")
    _day(zone, D[7], "c")
    load_attendance(spark, zone, warehouse, first_day="2024-01-05")
    _day(zone, D[6], "b")
    status = load_attendance(spark, zone, warehouse)
    assert status.days == status.behind == [D[6]] and not status.stalled
    assert _stored(spark, warehouse) == ["a", "b", "c"]


def test_misdated_row_fails_the_run_and_hides_no_day(spark, zone, warehouse):
    _day(zone, D[5], "a")
    _day(zone, D[5], "wrong", page=1, dated="2042-01-01")
    first = run(spark, zone, warehouse, only=["attendance"])
    assert first["attendance"].startswith("FAILED") and "2024-01-05" in first["attendance"]
    _day(zone, D[6], "b")
    _day(zone, D[7], "c")
    status = load_attendance(spark, zone, warehouse)
    assert status.stalled and status.ahead == [(D[5], dt.date(2042, 1, 1))] and status.behind == [D[6], D[7]]
    assert all(t in status.message for t in ("2024-01-05", "2042-01-01", "2024-01-06", "2024-01-07"))
    assert _stored(spark, warehouse) == ["a", "b", "c", "wrong"]
    _day(zone, D[5], "right", page=1)                               # landed anew
    assert not load_attendance(spark, zone, warehouse).stalled
    assert latest_loaded_date(spark, warehouse).first()[0] == D[7]


def test_row_of_the_next_day_within_landed_days_is_no_stall(spark, zone, warehouse):
    _day(zone, D[5], "night", dated="2024-01-06")
    _day(zone, D[6], "b")
    assert not load_attendance(spark, zone, warehouse).stalled


def test_incomplete_day_is_held_back_and_not_marked(spark, zone, warehouse):
    for d in (D[5], D[6]):
        for page in (0, 1, 2):
            if (d, page) != (D[6], 1):
                _day(zone, d, f"{d.day}-{page}", page=page)
    _day(zone, D[7], "unasked")
    totals = spark.createDataFrame([(D[5], 3), (D[6], 3)], "reportdate date, total long")
    kw = {"expected": totals, "page_size": 1}
    status = load_attendance(spark, zone, warehouse, **kw)
    assert status.days == [D[5]] and status.held == {D[6]: [1], D[7]: []} and "2024-01-06" in status.message
    assert [r["reportdate"] for r in read_marks(spark, f"{warehouse}/attendance").collect()] == [D[5]]
    _day(zone, D[6], "6-1", page=1)
    assert load_attendance(spark, zone, warehouse, **kw).days == [D[6]]
    assert len(_stored(spark, warehouse)) == 6


def test_held_late_day_keeps_its_stored_rows(spark, zone, warehouse):
    _day(zone, D[5], "a")
    totals = lambda n: spark.createDataFrame([(D[5], n)], "reportdate date, total long")
    load_attendance(spark, zone, warehouse, expected=totals(1), page_size=1)
    _day(zone, D[5], "b", page=2)
    assert load_attendance(spark, zone, warehouse, expected=totals(3), page_size=1).held == {D[5]: [1]}
    assert _stored(spark, warehouse) == ["a"]


def test_manifest_pages_and_names(spark):
    totals = spark.createDataFrame([(D[1], 2500), (D[2], 0), (D[3], None), (D[4], 1000)], "reportdate date, total long")
    m = paged_manifest(totals, "f")
    assert sorted((r[0].day, r[1]) for r in m.collect() if r[1] is not None) == [(1, 0), (1, 1), (1, 2), (2, 0), (4, 0)]
    want = request_manifest(totals, "f", day_col="reportdate", total_col="total")
    assert {r["path"] for r in m.collect()} == {r["path"] for r in want.collect()}
    names = spark.createDataFrame([("page-10.json",), ("p2_offset=3.json.gz",), ("none.json",), ("7",)], "file string")
    assert [r[0] for r in names.select(page_number("file")).collect()] == [10, 3, None, 7]
    files = spark.createDataFrame([(D[1], "p0.json"), (D[1], "p2.json"), (D[1], "p0-2.json"), (D[9], "p0.json"), (D[3], "p0.json")],
                                  "reportdate date, file string")
    got = {r["reportdate"].day: (r["pages"], r["landed"], r["missing"], r["whole"]) for r in completeness(m, files).collect()}
    assert got[1] == (3, 2, [1], False) and got[2] == (1, 0, [0], False) and got[3][3] is False and set(got) == {1, 2, 3, 4}


def test_files_are_listed_without_being_opened(spark, zone):
    _day(zone, D[5], "a")
    with open(f"{zone}/attendance/reportdate=2024-01-05/page-1.json", "w") as f:
        f.write("not json at all")
    files = landed_files(spark, f"{zone}/attendance")
    assert sorted((r["reportdate"], r["file"]) for r in files.collect()) == [(D[5], "page-0.json"), (D[5], "page-1.json")]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    assert landed_files(spark, f"{zone}/nothing").count() == 0 and landed_days(spark, f"{zone}/nothing").count() == 0
    one = landed_days(spark, f"{zone}/attendance").first()
    assert one["files"] == 2 and landed_days(spark, f"{zone}/attendance").first() == one


def test_day_states(spark):
    landed = spark.createDataFrame([(D[k], 1, 1, k) for k in (1, 2, 3, 4, 9)], "reportdate date, files long, bytes long, digest long")
    marks = spark.createDataFrame([(D[1], D[1], 1), (D[2], D[2], 7), (D[3], D[5], None)], "reportdate date, max_date date, digest long")
    got = {r[0].day: (r[1], r[2]) for r in day_states(landed, marks).collect()}
    assert got == {1: ("read", True), 2: ("late", True), 3: ("unknown", True), 4: ("new", True), 9: ("new", False)}
    assert {r["state"] for r in day_states(landed, None).collect()} == {"new"}


def test_adopted_table_is_not_loaded_again_but_later_changes_are_seen(spark, zone, warehouse):
    _day(zone, D[5], "a")
    load_days(spark, zone, f"{warehouse}/tmp", [D[5]])
    kept = read_days(spark, f"{warehouse}/tmp/attendance").withColumn("emp_id", F.lit("kept"))
    append_day(kept, f"{warehouse}/attendance")
    adopt_table(spark, warehouse)
    assert load_attendance(spark, zone, warehouse).days == [] and _stored(spark, warehouse) == ["kept"]
    _day(zone, D[5], "b", page=1)
    assert load_attendance(spark, zone, warehouse).late == [D[5]] and _stored(spark, warehouse) == ["a", "b"]


def test_marks_are_made_from_the_loaded_days_folders_alone(spark, warehouse):
    path = f"{warehouse}/attendance"
    days = spark.createDataFrame([(d, str(d)) for d in D[1:]], "reportdate date, log_date string")
    append_day(days, path)
    refresh_marks(spark, path)
    some = read_days(spark, path, days=[D[3], D[4]])
    assert len(some.inputFiles()) == 2 and some.count() == 2
    assert len(read_days(spark, path, first_day=D[27]).inputFiles()) == 2
    assert read_days(spark, path, days=[dt.date(2030, 1, 1)]) is None
    # A broken file of another day would fail any read or listing of its folder's content.
    os.rename(f"{path}/reportdate=2024-01-09", f"{warehouse}/aside")
    append_day(days.filter("reportdate = date'2024-01-03'").withColumn("log_date", F.lit("2024-02-02")), path)
    refresh_marks(spark, path, days=[D[3]])
    marks = {r["reportdate"]: r["max_date"] for r in read_marks(spark, path).collect()}
    assert len(marks) == 28 and marks[D[3]] == dt.date(2024, 2, 2) and marks[D[9]] == D[9]


def test_days_of_different_columns_read_filled_and_clashes_raise(spark, warehouse):
    path = f"{warehouse}/attendance"

    def store(day, ddl, *row):
        df = spark.createDataFrame([(day, *row)], f"reportdate date, {ddl}")
        append_day(df, path)
        refresh_marks(spark, path, days=[day], schema=df.schema)

    store(D[1], "log_date string, a string", "2024-01-01", "x")
    store(D[2], "log_date string, b long, a string", "2024-01-02", 7, "y")
    got = read_days(spark, path)
    assert got.columns == ["log_date", "a", "b", "reportdate"]
    assert sorted(tuple(r) for r in got.select("a", "b").collect()) == [("x", None), ("y", 7)]
    assert read_days(spark, path, days=[D[1]]).columns == ["log_date", "a", "reportdate"]
    store(D[3], "log_date string, a long", "2024-01-03", 1)
    with pytest.raises(SchemaClash, match="2024-01-03"):
        read_days(spark, path)
    assert read_days(spark, path, days=[D[1], D[2]]).count() == 2
    drop_days(spark, path, [D[3]])
    refresh_marks(spark, path, days=[D[3]])
    store(D[3], "log_date string, a string", "2024-01-03", "z")     # landed anew, as text
    assert read_days(spark, path).count() == 3


def test_rewrite_days_deletes_emptied_days_only(spark, warehouse):
    path = f"{warehouse}/t"
    df = spark.createDataFrame([(D[1], 1), (D[2], 2), (D[3], 3)], "reportdate date, v long")
    assert rewrite_days(df, path, D[1:4]) == []
    assert rewrite_days(df.filter("v = 1"), path, [D[1], D[2]]) == [D[2]]
    assert sorted(r["v"] for r in read_days(spark, path).collect()) == [1, 3]


# -- leave by day

def _leaves(zone, day, *emps, feed="leave", active="Y"):
    root = {"leave": "leavedetails", "tour": "tourdetails"}[feed]
    land(zone, feed, root, [_leave(e, active) for e in emps], day=day)


def _rows(df):
    return sorted(map(tuple, df.select(*schemas.LEAVE_COLUMNS).collect()), key=repr)


def _full(spark, zone, warehouse):
    refresh_leave(spark, zone, f"{warehouse}/full", stop=None)
    return _rows(read_table(spark, f"{warehouse}/full", "leave"))


def test_leave_reads_changed_days_only(spark, zone, warehouse, monkeypatch):
    from rollcall.plans import leave as plan
    for k in range(1, 8):
        _leaves(zone, D[k], f"e{k}", "x")
        _leaves(zone, D[k], f"t{k}", "x", feed="tour")
    read = []
    whole = plan.leave_history
    monkeypatch.setattr(plan, "leave_history", lambda a, b: (read.extend(a.inputFiles() + b.inputFiles()), whole(a, b))[1])
    assert refresh_leave_days(spark, zone, warehouse, stop=None) == D[1:8]
    assert len(read) == 14 and _rows(read_leave(spark, warehouse)) == _full(spark, zone, warehouse)
    read.clear()
    assert refresh_leave_days(spark, zone, warehouse, stop=None) == [] and not read
    _leaves(zone, D[2], "late one")                                  # an old day changes
    _leaves(zone, D[3], active="N")                                  # one feed of a day becomes empty
    _leaves(zone, D[4], "gone", active="N")
    _leaves(zone, D[4], "gone", active="N", feed="tour")             # nothing active is left of a day
    _leaves(zone, D[9], "new")
    assert refresh_leave_days(spark, zone, warehouse, stop=None) == [D[2], D[3], D[4], D[9]]
    assert {f.rpartition("reportdate=")[2][:10] for f in read} == {str(D[k]) for k in (2, 3, 4, 9)} and len(read) == 7
    got = _rows(read_leave(spark, warehouse))
    assert got == _full(spark, zone, warehouse) and D[4] not in {r[0] for r in got}


def test_leave_range_moves_and_final_days(spark, zone, warehouse):
    for k in (1, 2, 5, 6):
        _leaves(zone, D[k], f"e{k}")
    days = lambda: [r["date"].day for r in read_leave(spark, warehouse).orderBy("date").collect()]
    assert refresh_leave_days(spark, zone, warehouse, stop=D[5]) == [D[1], D[2], D[5]] and days() == [1, 2, 5]
    assert refresh_leave_days(spark, zone, warehouse, start=D[2], stop=D[6]) == [D[6]] and days() == [2, 5, 6]
    _leaves(zone, D[2], "changed")
    _leaves(zone, D[3], "first seen")
    assert refresh_leave_days(spark, zone, warehouse, start=D[2], stop=None, since=D[6]) == [D[3]]
    assert refresh_leave_days(spark, zone, warehouse, start=D[2], stop=None) == [D[2]]
    assert read_leave(spark, f"{warehouse}/never") is None


def test_leave_of_an_empty_landing(spark, zone, warehouse):
    assert refresh_leave_days(spark, zone, warehouse, stop=None) == []
    got = read_leave(spark, warehouse)
    assert got.columns == list(schemas.LEAVE_COLUMNS) and got.count() == 0


def test_stream_finds_days_without_reading_content(spark, zone, capsys):
    from rollcall.streaming.attendance import landed_days as stream_days
    _day(zone, D[5], "a")
    got = []
    q = (stream_days(spark, zone).writeStream.foreachBatch(lambda df, _: got.extend(df.collect()))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert [r[0] for r in got] == [D[5]]
    q.explain()
    plan = capsys.readouterr().out
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "binaryFile" in scan and "ReadSchema: struct<>" in scan      # no column of the files
