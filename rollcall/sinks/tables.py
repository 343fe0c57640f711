"""Table writes that are safe to repeat.

* ``append_day``: day-partitioned Parquet with dynamic partition overwrite. A first
  run appends the day, a re-run of the same day replaces exactly that day, and an
  empty day touches nothing. Days are committed one folder after another, so a crash can
  leave some of them: the marks written afterwards say which are loaded.
* ``replace_table``: each replace writes a new version folder, then appends one
  commit row naming it. Readers take the newest committed version, so a failed or
  lost write leaves the previous version current, and a table may be rebuilt from
  itself (read version n, write n+1), which a plain overwrite refuses.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.operators.union import merge_schemas
from rollcall.sources.envelope import day_folders

COMMITS = "_commits"
_COMMIT_SCHEMA = "version LONG, committed_at STRING"


def append_day(df: DataFrame, path: str, day_col: str = "reportdate",
               rebalance: bool = True) -> None:
    """Write ``df`` partitioned by ``day_col``, replacing only the days it contains.

    ``rebalance`` shuffles rows by day first (AQE ``REBALANCE``): each day lands in
    few, well-sized files instead of one file per input task per day, and a day
    holding a large share of the rows is split across several tasks, not one.
    """
    if rebalance:
        df = df.hint("rebalance", day_col)
    (df.write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(day_col)
       .parquet(path))


def marks_of(path: str) -> tuple[str, str]:
    """Root and name of the marks table that belongs to the day-partitioned table at ``path``."""
    root, _, name = path.rstrip("/").rpartition("/")
    return root, f"{name}_marks"


def recorded_schema(spark: SparkSession, path: str, days: list[dt.date] | None = None,
                    day_col: str = "reportdate") -> T.StructType | None:
    """The union of the column sets that the marks record for the stored days (or for ``days``),
    checked by type; ``None`` if a day has none recorded. One row a column set reaches the driver."""
    marks = read_table(spark, *marks_of(path))
    if marks is None or "schema" not in marks.columns:
        return None
    marks = marks.filter(F.col("rows") > 0)
    if days is not None:
        marks = marks.filter(F.col(day_col).isin(days))
    sets = marks.groupBy("schema").agg(F.min(day_col).alias("first")).orderBy("first").collect()
    if not sets or any(r["schema"] is None for r in sets):
        return None
    merged = merge_schemas([T.StructType.fromJson(json.loads(r["schema"])) for r in sets],
                           [f"the days from {r['first']} on" for r in sets])
    return T.StructType([*merged.fields, T.StructField(day_col, T.DateType(), True)])


def read_days(spark: SparkSession, path: str, schema: T.StructType | None = None, days: list[dt.date] | None = None,
              first_day: dt.date | None = None, day_col: str = "reportdate") -> DataFrame | None:
    """The day-partitioned table at ``path``; ``None`` if nothing (of the asked days) was ever written.

    ``days`` / ``first_day`` read those day folders alone: no other folder is listed. Columns are
    those the marks record for the stored days: a day stored without one of them reads as
    missing there, and two types of one column raise ``SchemaClash``. A table without marks
    takes its columns from one file.
    """
    folders = [path]
    if days is not None or first_day is not None:
        folders = day_folders(spark, path, first_day, None, days, day_col)
        if not folders:
            return None
    if schema is None:
        schema = recorded_schema(spark, path, days, day_col)
    try:
        reader = (spark.read if schema is None else spark.read.schema(schema)).option("basePath", path)
        return reader.parquet(*folders)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def day_files(spark: SparkSession, path: str, days: list[dt.date], day_col: str = "reportdate") -> dict[dt.date, frozenset[str]]:
    """Names of the stored files of those of ``days`` that are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for folder in day_folders(spark, path, None, None, days, day_col):
        at = jvm.org.apache.hadoop.fs.Path(folder)
        names = frozenset(s.getPath().getName() for s in at.getFileSystem(conf).listStatus(at))
        out[dt.date.fromisoformat(folder.rpartition("=")[2])] = names
    return out


def drop_days(spark: SparkSession, path: str, days: list[dt.date], day_col: str = "reportdate") -> list[dt.date]:
    """Delete the folders of ``days``; returns those that were stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = []
    for folder in (day_folders(spark, path, None, None, days, day_col) if days else ()):
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(conf).delete(at, True)
        gone.append(dt.date.fromisoformat(folder.rpartition("=")[2]))
    return sorted(gone)


def rewrite_days(df: DataFrame, path: str, days: list[dt.date], day_col: str = "reportdate") -> list[dt.date]:
    """:func:`append_day` for a frame that holds all there is of ``days``: a stored day among them
    that has no row any more is deleted. Returns the deleted days."""
    spark = df.sparkSession
    before = day_files(spark, path, days, day_col)
    append_day(df, path, day_col)
    after = day_files(spark, path, list(before), day_col)
    # A rewritten day has files of new names; one that was left alone got no row.
    return drop_days(spark, path, [d for d, names in before.items() if after.get(d) == names], day_col)


def _table_dir(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def _version_dir(root: str, table: str, version: int) -> str:
    return f"{_table_dir(root, table)}/v{version:06d}"


def current_version(spark: SparkSession, root: str, table: str) -> int | None:
    """Newest committed version number, or ``None`` for a table never written."""
    try:
        log = spark.read.schema(_COMMIT_SCHEMA).json(f"{_table_dir(root, table)}/{COMMITS}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    v = log.agg(F.max("version")).first()[0]
    return None if v is None else int(v)


def read_table(spark: SparkSession, root: str, table: str,
               schema: T.StructType | None = None) -> DataFrame | None:
    """Current version of a replaced table; ``None`` (or an empty frame with
    ``schema``, if given) when the table does not exist yet."""
    v = current_version(spark, root, table)
    if v is None:
        return None if schema is None else spark.createDataFrame([], schema)
    return spark.read.parquet(_version_dir(root, table, v))


def drop_old_versions(spark: SparkSession, root: str, table: str, keep: int) -> list[int]:
    """Delete the folders of all but the newest ``keep`` committed versions; returns which.
    The commit rows stay: they are the table's history."""
    if keep < 1:
        raise ValueError("the current version must stay")
    newest = current_version(spark, root, table)
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(_table_dir(root, table))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in (fs.listStatus(top) if newest is not None and fs.exists(top) else ()):
        name = status.getPath().getName()
        if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) <= newest - keep:
            fs.delete(status.getPath(), True)
            gone.append(int(name[1:]))
    return sorted(gone)


def replace_table(df: DataFrame, root: str, table: str) -> int:
    """Write ``df`` as the table's next version and commit it; returns the version.

    The data is fully written (job commit) before the one-row commit record is
    appended, so readers switch in one step. Old versions stay on disk until
    :func:`drop_old_versions` removes them (the daily run keeps a few).
    One writer per table is assumed.
    """
    spark = df.sparkSession
    prev = current_version(spark, root, table)
    version = 1 if prev is None else prev + 1
    # An uncommitted folder of this number can only be a failed earlier attempt.
    df.write.mode("overwrite").parquet(_version_dir(root, table, version))
    stamp = dt.datetime.now(dt.timezone.utc).isoformat()
    (spark.createDataFrame([(version, stamp)], _COMMIT_SCHEMA)
         .coalesce(1).write.mode("append").json(f"{_table_dir(root, table)}/{COMMITS}"))
    return version


# The employee table is rebuilt from itself; same mechanism, named for the intent.
replace_versioned = replace_table
