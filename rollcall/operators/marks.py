"""Load marks: next day to load (high-water mark), latest loaded day, day spine, emptiness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.dates import as_date, day_sequence, next_day


def _dtype(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.typeName()


def next_load_date(table: DataFrame, col: str = "log_date",
                   first: str | dt.date | None = None, name: str = "next_date") -> DataFrame:
    """One row: the day after the latest ``col`` (nulls ignored); ``first`` if there is none.

    ``max`` runs on the raw column (partial + final aggregate, and eligible for
    Parquet min/max pushdown); only the one result is converted to a date.
    """
    latest = as_date(F.max(F.col(col)), _dtype(table, col))
    out = next_day(latest)
    if first is not None:
        out = F.coalesce(out, F.lit(first).cast("date"))
    return table.agg(out.alias(name))


def latest_date(table: DataFrame, col: str = "log_date", name: str | None = None) -> DataFrame:
    """One row: the latest ``col`` as a date, **nulls first** as a descending
    PostgreSQL order puts them; a single missing date makes the answer missing.

    Plans as ``TakeOrderedAndProject`` (top-1 per task, then one merge).
    """
    out = name or col
    d = as_date(F.col(col), _dtype(table, col))
    return table.select(d.alias(out)).orderBy(F.col(out).desc_nulls_first()).limit(1)


def date_spine(bounds: DataFrame | SparkSession, start: Column | str | dt.date,
               stop: Column | str | dt.date, name: str = "date") -> DataFrame:
    """Every day from ``start`` to ``stop`` inclusive, one row each.

    ``bounds`` is a one-row frame the bounds are evaluated on (for instance the
    output of :func:`next_load_date`), or a session for literal bounds.
    ``stop < start`` raises, as the day step forbids counting backwards.
    """
    def _c(v):
        return v if isinstance(v, Column) else F.lit(v).cast("date")

    base = bounds.range(1) if isinstance(bounds, SparkSession) else bounds
    return base.select(F.explode(day_sequence(_c(start), _c(stop))).alias(name))


def has_rows(df: DataFrame, name: str = "has_rows") -> DataFrame:
    """One row, one boolean: does ``df`` have any row? Runs when called: ``isEmpty`` reads
    one partition, then more only while none had a row."""
    return df.sparkSession.range(1).select(F.lit(not df.isEmpty()).alias(name))
