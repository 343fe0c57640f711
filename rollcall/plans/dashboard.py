"""The dashboard's one figure: the latest loaded attendance date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcall.operators import latest_date
from rollcall.sinks import read_days
from rollcall.sinks.marks import latest_from_marks, read_marks


def latest_loaded_date(spark: SparkSession, warehouse: str, use_marks: bool = True,
                       table_name: str = "attendance") -> DataFrame | None:
    """One row ``last_date``: top ``log_date`` with nulls first, so a missing date
    shows as missing. Read from the per-day load marks when present (a few rows),
    else from the table (top-1 over every row)."""
    table = f"{warehouse}/{table_name}"
    if use_marks:
        marks = read_marks(spark, table)
        if marks is not None:
            return latest_from_marks(marks)
    stored = read_days(spark, table)
    return None if stored is None else latest_date(stored, "log_date", name="last_date")
