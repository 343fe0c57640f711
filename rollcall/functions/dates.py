"""Date expressions used by the loads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions._cols import as_col

ISO_DATE = "yyyy-MM-dd"
DAY_MONTH_YEAR = "dd MMM yyyy"   # 05 Jan 2024


def parse_date(c: Column | str) -> Column:
    """ISO text (or a date / timestamp) to a date; malformed text raises (ANSI mode)."""
    return F.to_date(as_col(c), ISO_DATE)


def as_date(c: Column | str, dtype: str) -> Column:
    """Date of ``c`` whatever its stored type: text is parsed, timestamps truncated."""
    col = as_col(c)
    if dtype == "string":
        return parse_date(col)
    return col.cast("date")


def next_day(c: Column | str) -> Column:
    """The following day; null stays null."""
    return F.date_add(as_col(c), 1)


def iso_text(c: Column | str) -> Column:
    """``yyyy-MM-dd`` text of a date, local timestamp or ISO text. A cast, not a
    formatter: no session-time-zone round trip for ``timestamp_ntz`` values."""
    return as_col(c).cast("date").cast("string")


def format_day(c: Column | str) -> Column:
    """``05 Jan 2024`` style, as printed in load status lines."""
    return F.date_format(as_col(c), DAY_MONTH_YEAR)


def day_sequence(start: Column, stop: Column) -> Column:
    """Inclusive array of days; raises if ``stop < start`` (the explicit step forbids counting back)."""
    return F.sequence(start, stop, F.expr("INTERVAL 1 DAY"))
