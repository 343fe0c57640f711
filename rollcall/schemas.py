"""Declared record schemas for the landed JSON feeds.

Every payload field is text (ids such as ``org_id = "000046"`` keep their zeros).
Only the fields the loads use are listed; other payload fields are passed through
by adding them with :func:`with_extra`, never inferred (an empty payload would
infer as ``array<string>`` and lose every field).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

# Root key of each feed's JSON envelope.
ROOT_ATTENDANCE = "successattendance"
ROOT_DEVICES = "detailsbydeviceid"
ROOT_LEAVE = "leavedetails"
ROOT_TOUR = "tourdetails"
ROOT_EMPLOYEE = "employee"
ROOT_HOLIDAY = "holiday"


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def with_extra(schema: T.StructType, extra: Iterable[str]) -> T.StructType:
    have = set(schema.fieldNames())
    return T.StructType(schema.fields + [T.StructField(n, T.StringType(), True)
                                         for n in extra if n not in have])


ATTENDANCE = strings("emp_id", "log_date", "in_device_id", "out_device_id")
DEVICES = strings("device_id", "org_id", "entry_name", "org_name")
LEAVE_SHARED = ("emp_id", "leave_type", "reason", "created_by", "creation_date")
LEAVE = strings("active_status", *LEAVE_SHARED)
TOUR = strings("active_status", *LEAVE_SHARED)
EMPLOYEE = strings("emp_id", "emp_name", "designation", "division")
HOLIDAY = strings("holiday_date", "holiday_name")

# Stored leave history: the one typed column is the day.
LEAVE_COLUMNS = ("date", *LEAVE_SHARED)
