"""The daily run: every load, each on its own, then the dashboard figure.

    spark-submit --py-files rollcall.zip -m rollcall.daily --landing s3://... --warehouse s3://...
    python -m rollcall.daily --landing /data/landing --warehouse /data/warehouse --local

Loads are independent: a failure in one is reported and the others still run
(the exit code is non-zero if any failed, or if a misdated row makes the attendance mark
useless). Each load is safe to re-run.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
import traceback

from pyspark.sql import DataFrame, SparkSession

from rollcall.plans import (
    latest_loaded_date, load_attendance, refresh_leave_days, replace_holidays, upsert_employees,
)
from rollcall.sinks import drop_old_versions
from rollcall.plans.attendance import next_attendance_day
from rollcall.plans.leave import HISTORY_START


KEEP_VERSIONS = 3             # of each replaced table, for readers that are still at work


def run(spark: SparkSession, landing: str, warehouse: str, first_day: str | None = None,
        history_start: str = HISTORY_START, only: list[str] | None = None,
        multi_line: bool = True, leave_window_days: int | None = None,
        attendance_totals: DataFrame | None = None) -> dict[str, str]:
    """``attendance_totals`` (``reportdate``, ``total``) holds back days whose pages have not all landed."""
    ml = {"multi_line": multi_line}
    # The run's day is fixed once, before anything is appended, and bounds the leave days too.
    day = next_attendance_day(spark, warehouse, first_day)
    leave_since = None
    if leave_window_days is not None and day is not None:
        leave_since = day - dt.timedelta(days=leave_window_days)

    def attendance() -> str:
        status = load_attendance(spark, landing, warehouse, first_day=first_day, expected=attendance_totals, **ml)
        # Rows are loaded, but the mark is wrong until the day is landed anew: the run must not pass.
        return f"FAILED: {status.message}" if status.stalled else status.message

    steps = {
        "attendance": attendance,
        "leave": lambda: "Leave history updated (days rewritten: "
                         f"{len(refresh_leave_days(spark, landing, warehouse, history_start, day, since=leave_since, **ml))})",
        "employee": lambda: f"Employee register updated (version {upsert_employees(spark, landing, warehouse, **ml)})",
        "holiday": lambda: f"Holidays replaced (version {replace_holidays(spark, landing, warehouse, **ml)})",
    }
    out: dict[str, str] = {}
    for name, step in steps.items():
        if only and name not in only:
            continue
        try:
            out[name] = step()
        except Exception as e:  # noqa: BLE001 -- report and keep going, like independent jobs
            traceback.print_exc()
            out[name] = f"FAILED: {type(e).__name__}: {e}"
    for name in ("leave_read", "employee", "holiday", "attendance_marks"):
        drop_old_versions(spark, warehouse, name, KEEP_VERSIONS)
    latest = latest_loaded_date(spark, warehouse)
    out["latest_date"] = str(latest.first()["last_date"]) if latest is not None else "none"
    return out


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="rollcall.daily")
    ap.add_argument("--landing", required=True)
    ap.add_argument("--warehouse", required=True)
    ap.add_argument("--first-day", default=None, help="first attendance day when nothing is stored yet")
    ap.add_argument("--history-start", default=HISTORY_START)
    ap.add_argument("--only", nargs="*", choices=["attendance", "leave", "employee", "holiday"])
    ap.add_argument("--leave-window-days", type=int, default=None,
                    help="look for changed leave/tour files in this many days before the run's day only "
                         "(older days that were read once are final)")
    ap.add_argument("--attendance-totals", default=None,
                    help="JSON lines with reportdate and total (records of the day): days whose pages have not "
                         "all landed are held back")
    ap.add_argument("--json-lines", action="store_true",
                    help="landed files hold one envelope per line (splittable) instead of one per file")
    ap.add_argument("--local", action="store_true", help="run in a local session (tests, laptops)")
    args = ap.parse_args(argv)
    if args.local:
        from rollcall.session import local_session
        spark = local_session()
    else:
        from rollcall.session import BASE_CONF
        spark = SparkSession.builder.appName("rollcall-daily").config(map=BASE_CONF).getOrCreate()
    totals = None
    if args.attendance_totals:
        totals = spark.read.schema("reportdate date, total long").option("mode", "FAILFAST").json(args.attendance_totals)
    result = run(spark, args.landing, args.warehouse, args.first_day, args.history_start, args.only,
                 multi_line=not args.json_lines, leave_window_days=args.leave_window_days, attendance_totals=totals)
    for name, msg in result.items():
        print(f"{name}: {msg}")
    return 1 if any(m.startswith("FAILED") for m in result.values()) else 0


if __name__ == "__main__":
    sys.exit(main())
