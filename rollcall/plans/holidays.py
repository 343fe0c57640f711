"""Holiday calendar: landed payload written unchanged as the table's new version."""

from __future__ import annotations

from pyspark.sql import SparkSession

from rollcall import schemas
from rollcall.sinks import replace_table
from rollcall.sources import FILE_COL, POS_COL, read_envelope


def replace_holidays(spark: SparkSession, landing: str, warehouse: str,
                     record=schemas.HOLIDAY, multi_line: bool = True) -> int:
    hol = read_envelope(spark, f"{landing}/holiday", schemas.ROOT_HOLIDAY, record, multi_line=multi_line)
    return replace_table(hol.drop(FILE_COL, POS_COL), warehouse, "holiday")
