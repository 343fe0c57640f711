"""Daily attendance load: landed files against marks -> days to load -> device locations -> day replace."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.functions import if_else, title_case
from rollcall.operators import distinct_keys, lookup_keys, role_join
from rollcall.sinks import drop_days, rewrite_days
from rollcall.sinks.marks import day_states, marks_ahead, next_day_from_marks, note_prints, read_marks, refresh_marks
from rollcall.sources import (
    DAY_COL, FILE_COL, POS_COL, completeness, keyed_scan, landed_days, landed_files, paged_manifest,
    read_envelope,
)

# The organisation whose devices keep their own entry name, and the
# device-id text that means "no device".
OWN_NAME_ORG = "000046"
NO_DEVICE = ""

ROLES = {"in_device_id": "in_location", "out_device_id": "out_location"}


def device_locations(devices: DataFrame, own_name_org: str = OWN_NAME_ORG) -> DataFrame:
    """Location shown for a device: its own ``entry_name`` for one organisation,
    else the title-cased ``org_name``; a missing ``org_id`` gives a missing location."""
    loc = if_else(F.col("org_id") == F.lit(own_name_org), F.col("entry_name"), title_case("org_name"))
    return devices.withColumn("entry_name", loc)


def enrich_attendance(attendance: DataFrame, devices: DataFrame, dedupe_dim: bool = False,
                      broadcast: bool | None = None, salt_buckets: int = 0) -> DataFrame:
    """Add ``in_location`` / ``out_location``: the device table joined once per role,
    null-safe, every attendance row kept (``""`` and unknown ids get no location).
    ``salt_buckets`` splits hot device ids explicitly if the devices are not broadcast."""
    dev = device_locations(devices)
    # "" means "no device", also where a landed device carries it as its id.
    dev = dev.filter(F.col("device_id").isNull() | (F.col("device_id") != F.lit(NO_DEVICE)))
    return role_join(attendance, dev, ROLES, "device_id", "entry_name",
                     dedupe_dim=dedupe_dim, broadcast=broadcast, salt_buckets=salt_buckets)


def device_keys(attendance: DataFrame) -> DataFrame:
    """Distinct device ids seen in either role, minus the no-device text (null kept)."""
    return distinct_keys(attendance, list(ROLES), exclude=NO_DEVICE, name="device_id")


def next_attendance_day(spark: SparkSession, warehouse: str,
                        first_day: str | dt.date | None = None) -> dt.date | None:
    """Day after the latest stored ``log_date`` as the load marks have it, else ``first_day``.

    Marks are written after the days they describe, so days without marks may be what a
    crash left of a load: they are loaded again from the first day on, which replaces
    them. A table from elsewhere is taken over by :func:`adopt_table` only.
    """
    if isinstance(first_day, str):
        first_day = dt.date.fromisoformat(first_day)
    marks = read_marks(spark, f"{warehouse}/attendance")
    return first_day if marks is None else next_day_from_marks(marks, first_day)


def adopt_table(spark: SparkSession, warehouse: str) -> None:
    """Take an existing, complete attendance table as loaded: mark all its days (one scan)."""
    refresh_marks(spark, f"{warehouse}/attendance", None)


def load_days(spark: SparkSession, landing: str, warehouse: str, days: list[dt.date],
              devices: DataFrame | None = None, dedupe_dim: bool = False, multi_line: bool = True,
              record=schemas.ATTENDANCE, device_record=schemas.DEVICES, restrict_devices: bool = False,
              salt_buckets: int = 0, prints: DataFrame | None = None, device_buckets: int | None = None) -> bool:
    """Load ``days`` whole from what has landed for them, replacing them, and mark them with the
    landed files' fingerprints (``prints``; taken here, before any file is read, if not given). A stored
    day of which nothing is left goes. Returns whether a row was loaded."""
    if not days:
        return False
    path, table = f"{landing}/attendance", f"{warehouse}/attendance"
    prints = landed_days(spark, path, days=days) if prints is None else prints.filter(F.col(DAY_COL).isin(days))
    att = read_envelope(spark, path, schemas.ROOT_ATTENDANCE, record, dated=True,
                        multi_line=multi_line, days=days).drop(FILE_COL, POS_COL)
    if att.isEmpty():          # scans partitions incrementally, stops at the first row
        drop_days(spark, table, days)
        refresh_marks(spark, table, days=days, prints=prints)
        return False
    if devices is None and device_buckets:
        devices = keyed_scan(spark, f"{landing}/devices_by_key", "device_id", device_keys(att), device_buckets)
    if devices is None:
        devices = read_envelope(spark, f"{landing}/devices", schemas.ROOT_DEVICES, device_record,
                                multi_line=multi_line).drop(FILE_COL, POS_COL)
    if restrict_devices:
        devices = lookup_keys(devices, "device_id", device_keys(att))
    out = enrich_attendance(att, devices, dedupe_dim=dedupe_dim, salt_buckets=salt_buckets)
    rewrite_days(out, table, days)
    refresh_marks(spark, table, days=days, prints=prints, schema=out.schema)
    return True


@dataclass
class LoadStatus:
    """What a load did. ``late`` days were loaded before and landed anew; ``held`` days wait for pages
    (their missing numbers are listed; empty when the manifest has no total for the day);
    ``behind`` days had never been read though the high-water mark lay past them;
    ``ahead`` are (day, date): rows of that day whose date moves the mark past landed days."""

    loaded: bool
    from_day: dt.date | None
    message: str
    days: list[dt.date] = field(default_factory=list)
    late: list[dt.date] = field(default_factory=list)
    held: dict[dt.date, list[int]] = field(default_factory=dict)
    behind: list[dt.date] = field(default_factory=list)
    ahead: list[tuple[dt.date, dt.date]] = field(default_factory=list)

    @property
    def stalled(self) -> bool:
        """The mark cannot be trusted: by it alone landed days would stay unread."""
        return bool(self.ahead)


def _listed(days: list[dt.date], most: int = 10) -> str:
    more = f" and {len(days) - most} more" if len(days) > most else ""
    return ", ".join(d.isoformat() for d in days[:most]) + more


def held_days(expected: DataFrame, files: DataFrame, days: list[dt.date], page_size: int = 1000,
              first_page: int = 0) -> dict[dt.date, list[int]]:
    """Those of ``days`` that are not whole by ``expected`` (day, total), with their missing pages; a day that
    ``expected`` does not know is not whole."""
    manifest = paged_manifest(expected, "attendance", page_size, first_page).filter(F.col(DAY_COL).isin(days))
    state = completeness(manifest, files, page_size, first_page).select(DAY_COL, "missing", "whole").collect()          # one row a day
    whole = {r[DAY_COL] for r in state if r["whole"]}
    missing = {r[DAY_COL]: r["missing"] for r in state}
    return {d: missing.get(d, []) for d in days if d not in whole}


def load_attendance(spark: SparkSession, landing: str, warehouse: str,
                    first_day: str | dt.date | None = None, dedupe_dim: bool = False,
                    restrict_devices: bool = False, multi_line: bool = True, salt_buckets: int = 0,
                    record=schemas.ATTENDANCE, device_record=schemas.DEVICES,
                    expected: DataFrame | None = None, page_size: int = 1000, first_page: int = 0,
                    device_buckets: int | None = None) -> LoadStatus:
    """Load every landed attendance day that no load has read as it now stands.

    The landed day folders are listed (no file is opened) and each day's files are compared
    with those its mark says it was loaded from: a day without a mark is new, a day whose
    files differ is late and rebuilt whole. Days before ``first_day`` (default: before the first
    loaded day) are left alone. What reaches the driver is one row a day.

    With ``expected`` (``reportdate``, ``total`` records) a day is loaded only once all its pages of
    ``page_size`` have landed, numbered from ``first_page`` by the last number of their names; the
    others are held back, reported and not marked.

    A date far ahead of its day would hide landed days behind the high-water mark. They are
    loaded all the same, and the status is stalled and names both.
    ``restrict_devices`` first semi-joins the device table with the ids in use
    (same result; worthwhile only when the device table dwarfs the day's ids). With
    ``device_buckets`` the devices are those that :func:`rollcall.sources.land_by_key` laid out in so many
    buckets, of which only the buckets of ids in use are read.
    """
    path, table = f"{landing}/attendance", f"{warehouse}/attendance"
    start = next_attendance_day(spark, warehouse, first_day)
    first = dt.date.fromisoformat(first_day) if isinstance(first_day, str) else first_day
    marks = read_marks(spark, table)
    if first is None and marks is not None:
        first = marks.agg(F.min(DAY_COL)).first()[0]

    prints = landed_days(spark, path, first_day=first)
    states = {r[DAY_COL]: r for r in day_states(prints, marks).collect()}                       # one row a day
    if any(r["state"] == "unknown" for r in states.values()):
        note_prints(spark, table, prints)
    todo = sorted(d for d, r in states.items() if r["state"] in ("new", "late"))
    held = {}
    if expected is not None and todo:
        held = held_days(expected, landed_files(spark, path, days=todo), todo, page_size, first_page)
    days = [d for d in todo if d not in held]
    late = [d for d in days if states[d]["state"] == "late"]
    behind = [d for d in todo if states[d]["state"] == "new" and states[d]["behind"]]

    loaded = load_days(spark, landing, warehouse, days, dedupe_dim=dedupe_dim, multi_line=multi_line, record=record,
                       device_record=device_record, restrict_devices=restrict_devices, salt_buckets=salt_buckets, prints=prints,
                       device_buckets=device_buckets)
    ahead = _ahead(read_marks(spark, table), behind, max(states, default=None))

    message = "No New Attendance Data"
    if loaded:
        if len(late) < len(days):
            message = f"Attendance Updated for {start.strftime('%d %b %Y') if start else 'all landed days'}"
        else:
            message = "Attendance Updated"
    if late:
        message += f"; rebuilt from changed files: {_listed(late)}"
    if held:
        message += f"; held back until all pages land: {_listed(sorted(held))}"
    if ahead:
        message += "; STALLED: " + ", ".join(f"rows of {d.isoformat()} are dated {m.isoformat()}" for d, m in ahead)
        message += f", ahead of landed days not yet read: {_listed(behind)}" if behind else ", past the newest landed day"
    return LoadStatus(loaded, start, message, days, late, held, behind, ahead)


def _ahead(marks: DataFrame | None, behind: list[dt.date], newest: dt.date | None) -> list[tuple[dt.date, dt.date]]:
    """Marked days whose dates lie at or past the first day behind, or past the newest landed day."""
    if marks is None or newest is None:
        return []
    past = min([*behind, newest + dt.timedelta(days=1)])
    return [(r[DAY_COL], r["max_date"]) for r in marks_ahead(marks, past).limit(100).collect()]
