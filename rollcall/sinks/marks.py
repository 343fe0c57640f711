"""Per-day load marks for a day-partitioned table.

The next day to load and the latest loaded date are both questions about the whole
table (a max, and "is any date missing"). Asked of the table itself they scan its
full history every day. Instead, each load recomputes one row per day it wrote,
from just those day partitions (partition-pruned, two columns), and merges them
into a small marks table replaced as a new version. A reloaded day replaces its
own mark, so the marks always describe the table's current content.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.dates import as_date
from rollcall.sinks.tables import marks_of, read_days, read_table, replace_table
from rollcall.sources.envelope import day_folders
from rollcall.sources.landed import PRINT

_PRINT = [c.split()[0] for c in PRINT.split(", ")]


def day_marks(days: DataFrame, col: str = "log_date", day_col: str = "reportdate") -> DataFrame:
    """One row per day: latest ``col`` (as a date), count of missing ``col``, rows."""
    dtype = days.schema[col].dataType.typeName()
    return days.groupBy(day_col).agg(
        as_date(F.max(F.col(col)), dtype).alias("max_date"),
        F.count(F.when(F.col(col).isNull(), 1)).alias("missing_dates"),
        F.count(F.lit(1)).alias("rows"))


def refresh_marks(spark: SparkSession, table_path: str, since: dt.date | None = None,
                  col: str = "log_date", day_col: str = "reportdate", days: list[dt.date] | None = None,
                  prints: DataFrame | None = None, schema: T.StructType | None = None) -> None:
    """Recompute the marks of every day ``>= since``, or of ``days`` alone (all days if
    neither is given); the other marks stay. Only the folders of those days are listed.

    ``prints`` (:func:`rollcall.sources.landed_days`) are the landed files the days were loaded
    from; a day that has them and no stored row gets a mark of 0 rows, so it counts as
    read. ``schema`` are the stored columns, taken from the days' files if not given.
    """
    if days is not None and not days:
        return
    root, name = marks_of(table_path)
    stored = None if schema is None else T.StructType([*(f for f in schema.fields if f.name != day_col),
                                                       T.StructField(day_col, T.DateType(), True)])
    table = read_days(spark, table_path, stored, days, since, day_col)
    if table is None and prints is None:
        return
    if table is not None:
        if schema is None:                                 # several loads' files: the columns of all
            folders = [table_path] if days is None and since is None else day_folders(spark, table_path, since, None, days, day_col)
            schema = spark.read.option("basePath", table_path).option("mergeSchema", "true").parquet(*folders).schema
        kept = T.StructType([f for f in schema.fields if f.name != day_col])
        fresh = day_marks(table, col, day_col).withColumn("schema", F.lit(kept.json()))
    else:
        fresh = spark.createDataFrame([], f"{day_col} date, max_date date, missing_dates long, rows long, schema string")
    if prints is None:
        fresh = fresh.select("*", *[F.lit(None).cast("long").alias(c) for c in _PRINT])
    else:
        fresh = (prints.select(day_col, *_PRINT).join(fresh, day_col, "full").fillna(0, ["missing_dates", "rows"])
                 .select(*fresh.columns, *_PRINT))
    old = read_table(spark, root, name)
    if old is not None and (since is not None or days is not None):
        again = F.col(day_col).isin(days) if days is not None else F.col(day_col) >= F.lit(since)
        keep = old.filter(~F.coalesce(again, F.lit(False)))
        fresh = keep.unionByName(fresh, allowMissingColumns=True).select(*fresh.columns)
    replace_table(fresh, root, name)


def note_prints(spark: SparkSession, table_path: str, prints: DataFrame, day_col: str = "reportdate") -> None:
    """Take ``prints`` as what the marked days without a fingerprint (an adopted table) were loaded from."""
    root, name = marks_of(table_path)
    marks = read_table(spark, root, name)
    new = prints.select(day_col, *[F.col(c).alias(f"__{c}") for c in _PRINT])
    filled = [F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in marks.columns else F.col(f"__{c}").alias(c)
              for c in _PRINT]
    rest = [c for c in marks.columns if c not in _PRINT]
    replace_table(marks.join(new, day_col, "left").select(*rest, *filled), root, name)


def day_states(landed: DataFrame, marks: DataFrame | None, day_col: str = "reportdate") -> DataFrame:
    """Each landed day against the marks: ``reportdate, state, behind``.

    ``new``: no load has read it; ``late``: its landed files are not those it was loaded from;
    ``unknown``: loaded from files that were not recorded; ``read``: as loaded. ``behind`` tells
    whether the high-water mark already lies past the day.
    """
    if marks is None:
        return landed.select(day_col, F.lit("new").alias("state"), F.lit(False).alias("behind"))
    digest = F.col("digest") if "digest" in marks.columns else F.lit(None).cast("long")
    known = marks.select(day_col, digest.alias("__digest"), F.lit(True).alias("__marked"))
    top = marks.agg(F.max("max_date")).first()[0]
    state = (F.when(F.col("__marked").isNull(), "new").when(F.col("__digest").isNull(), "unknown")
             .when(F.col("__digest") != F.col("digest"), "late").otherwise("read"))
    behind = F.lit(False) if top is None else F.col(day_col) <= F.lit(top)
    return landed.join(known, day_col, "left").select(day_col, state.alias("state"), behind.alias("behind"))


def marks_ahead(marks: DataFrame, past: dt.date, day_col: str = "reportdate") -> DataFrame:
    """Days with a date later than the day itself that moves the mark past the day ``past``."""
    return (marks.filter((F.col("max_date") > F.col(day_col)) & (F.col("max_date") >= F.lit(past)))
            .select(day_col, "max_date").orderBy(day_col))


def read_marks(spark: SparkSession, table_path: str) -> DataFrame | None:
    return read_table(spark, *marks_of(table_path))


def next_day_from_marks(marks: DataFrame, first: dt.date | None = None) -> dt.date | None:
    latest = marks.agg(F.max("max_date")).first()[0]
    return first if latest is None else latest + dt.timedelta(days=1)


def latest_from_marks(marks: DataFrame, name: str = "last_date") -> DataFrame:
    """One row: missing if any day holds a missing date (nulls sort first), else the max."""
    return marks.agg(F.when(F.sum("missing_dates") > 0, F.lit(None).cast("date"))
                      .otherwise(F.max("max_date")).alias(name))
