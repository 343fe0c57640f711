"""Leave and tour history from a fixed first day: rebuilt in full and replaced, or kept by day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.operators import bind_by_name
from rollcall.sinks import drop_days, read_days, read_table, replace_table, rewrite_days
from rollcall.sources import DAY_COL, FILE_COL, POS_COL, day_folders, fingerprints, landed_files, read_envelope

# Fixed value: first day of the rebuilt history.
HISTORY_START = "2024-01-01"


def leave_history(leave: DataFrame, tour: DataFrame, day_col: str = DAY_COL,
                  active_col: str = "active_status") -> DataFrame:
    """Active (``"Y"``) leave and tour records, united by name, one row per distinct
    ``(date, emp_id, leave_type, reason, created_by, creation_date)``.

    The day is stamped before the distinct, so a leave listed on three days stays
    three rows; rows differing only in unselected columns merge. Filter and distinct
    run once over all days (they commute with the per-day loop they replace).
    """
    feeds = [f.filter(F.col(active_col) == F.lit("Y")) for f in (leave, tour)]
    both = bind_by_name(*feeds)
    cols = [F.col(day_col).cast("date").alias("date")] + [F.col(c) for c in schemas.LEAVE_SHARED]
    return both.select(*cols).distinct()


def leave_window(leave: DataFrame, tour: DataFrame, stored: DataFrame | None,
                 since, day_col: str = DAY_COL) -> DataFrame:
    """:func:`leave_history` of the days from ``since`` on, plus the ``stored`` rows
    of earlier days. Exact while the earlier days' payloads are unchanged."""
    since = since if isinstance(since, Column) else F.lit(since).cast("date")
    recent = leave_history(leave.filter(F.col(day_col) >= since),
                           tour.filter(F.col(day_col) >= since), day_col)
    if stored is None:
        return recent
    return stored.filter(F.col("date") < since).unionByName(recent)


NEXT_DAY = "next"
_COVERED = "leave_covered"


def covered_days(spark: SparkSession, warehouse: str) -> tuple[dt.date, dt.date] | None:
    """First and last day the stored leave table was built from; ``None`` if unknown."""
    got = read_table(spark, warehouse, _COVERED)
    row = None if got is None else got.first()
    return None if row is None or row["last"] is None else (row["first"], row["last"])


def refresh_leave(spark: SparkSession, landing: str, warehouse: str,
                  start: str | dt.date = HISTORY_START, stop: str | dt.date | None = NEXT_DAY,
                  multi_line: bool = True, since: str | dt.date | None = None) -> int:
    """Rebuild the leave table from ``start`` through ``stop`` (default: the next
    attendance day to load; ``None``: all landed days) and replace it; returns the new
    table version. The days it was built from are recorded after it.

    ``since`` (opt-in) re-reads only landed days from ``since`` on and keeps the stored
    rows of earlier days. It never reaches past what is stored: with no recorded days,
    or another ``start``, the rebuild is full, and after missed runs it goes back to the
    first day not yet covered. The result equals a full rebuild as long as the covered
    days before it are final: the distinct key includes the day, so days never mix.
    """
    start = _as_day(start)
    if stop == NEXT_DAY:
        from rollcall.plans.attendance import next_attendance_day
        stop = next_attendance_day(spark, warehouse)
    stop = _as_day(stop)
    covered = covered_days(spark, warehouse)
    stored = read_table(spark, warehouse, "leave")
    if since is not None:
        if stored is None or covered is None or covered[0] != start:
            since = None
        else:
            since = max(start, min(_as_day(since), covered[1] + dt.timedelta(days=1)))
    first = start if since is None else since

    def feed(name: str, root: str, record) -> DataFrame:
        df = read_envelope(spark, f"{landing}/{name}", root, record, dated=True, multi_line=multi_line,
                           first_day=first, last_day=stop)
        return df.drop(FILE_COL, POS_COL)

    leave = feed("leave", schemas.ROOT_LEAVE, schemas.LEAVE)
    tour = feed("tour", schemas.ROOT_TOUR, schemas.TOUR)
    if since is None:
        out = leave_history(leave, tour)
    else:
        out = leave_window(leave, tour, stored, since)
        if stop is not None:
            out = out.filter(F.col("date") <= F.lit(stop))
    last = stop
    if last is None:                          # no bound: covered as far as anything has landed
        days = leave.select(DAY_COL).unionByName(tour.select(DAY_COL)).agg(F.max(DAY_COL)).first()[0]
        last = max([d for d in (days, covered[1] if covered and since else None) if d], default=None)
    version = replace_table(out, warehouse, "leave")
    row = spark.createDataFrame([(start, last)], "first date, last date")
    replace_table(row, warehouse, _COVERED)
    return version


DAYS = "leave_days"           # the day-partitioned leave table
_READ = "leave_read"          # one row a day of it: what it was built from


def _leave_prints(spark: SparkSession, landing: str, first: dt.date, last: dt.date | None,
                  final: set[dt.date]) -> dict[dt.date, int]:
    """One number a landed day that changes with the leave or tour files of the day; the folders of
    ``final`` days are not looked into."""
    feeds = []
    for name in ("leave", "tour"):
        path = f"{landing}/{name}"
        landed = {dt.date.fromisoformat(f.rpartition("=")[2]) for f in day_folders(spark, path, first, last)}
        feeds.append(landed_files(spark, path, days=sorted(landed - final)).withColumn("feed", F.lit(name)))
    per = fingerprints(feeds[0].unionByName(feeds[1]), "feed")
    day = per.groupBy(DAY_COL).agg(F.bit_xor(F.xxhash64("feed", "files", "bytes", "digest")).alias("print"))
    return {r[DAY_COL]: r["print"] for r in day.filter(F.col(DAY_COL).isNotNull()).collect()}     # one row a day


def refresh_leave_days(spark: SparkSession, landing: str, warehouse: str, start: str | dt.date = HISTORY_START,
                       stop: str | dt.date | None = NEXT_DAY, multi_line: bool = True,
                       since: str | dt.date | None = None, leave_record=schemas.LEAVE,
                       tour_record=schemas.TOUR) -> list[dt.date]:
    """The leave history of :func:`refresh_leave`, one folder a day, of which only the days whose landed
    leave or tour files changed since they were read are read and rewritten; returns those.

    The distinct key holds the day, so days never mix and the table equals a full rebuild.
    A day of which nothing is left goes, as do days outside ``start`` to ``stop``. Days whose landed
    folders are gone stay as stored. ``since`` takes the days before it that were read once as
    final and does not look at their files. What was read is recorded after the days are
    written: a run that fails is done again.
    """
    start, since = _as_day(start), _as_day(since)
    if stop == NEXT_DAY:
        from rollcall.plans.attendance import next_attendance_day
        stop = next_attendance_day(spark, warehouse)
    stop = _as_day(stop)
    table = f"{warehouse}/{DAYS}"
    inside = lambda d: d >= start and (stop is None or d <= stop)
    stored = read_table(spark, warehouse, _READ)
    known = {r[DAY_COL]: r["print"] for r in stored.collect()} if stored is not None else {}      # one row a day
    now = _leave_prints(spark, landing, start, stop, {d for d in known if since is not None and d < since})
    changed = sorted(d for d, p in now.items() if known.get(d) != p)
    outside = [d for d in known if not inside(d)]
    if changed:
        feeds = [read_envelope(spark, f"{landing}/{name}", root, record, dated=True, multi_line=multi_line, days=changed)
                 .drop(FILE_COL, POS_COL) for name, root, record in
                 (("leave", schemas.ROOT_LEAVE, leave_record), ("tour", schemas.ROOT_TOUR, tour_record))]
        rewrite_days(leave_history(*feeds), table, changed, "date")
    if outside:
        drop_days(spark, table, outside, "date")
    if changed or outside or stored is None:
        kept = {d: p for d, p in known.items() if inside(d)} | {d: now[d] for d in changed}
        replace_table(spark.createDataFrame(sorted(kept.items()), f"{DAY_COL} date, print long").coalesce(1), warehouse, _READ)
    return changed


def read_leave(spark: SparkSession, warehouse: str) -> DataFrame | None:
    """The leave history: the day table if :func:`refresh_leave_days` keeps one, else the replaced table."""
    if read_table(spark, warehouse, _READ) is None:
        return read_table(spark, warehouse, "leave")
    columns = schemas.strings(*schemas.LEAVE_SHARED).add("date", "date")
    stored = read_days(spark, f"{warehouse}/{DAYS}", columns, day_col="date")
    stored = spark.createDataFrame([], columns) if stored is None else stored
    return stored.select(*schemas.LEAVE_COLUMNS)


def _as_day(day: str | dt.date | None) -> dt.date | None:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day
