"""JSON envelopes: ``{"<root>": [ {record}, ... ]}``, one object per file.

A landing zone holds one folder per feed; dated feeds are partitioned
``reportdate=YYYY-MM-DD``. Reading uses a declared schema, so an empty array or
an absent root key gives zero rows (not a schema-less frame), and each record
carries its file and position in the payload, which keep-first needs for order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_COL = "_file"
POS_COL = "_pos"
DAY_COL = "reportdate"


def envelope_schema(root: str, record: T.StructType, dated: bool = False) -> T.StructType:
    fields = [T.StructField(root, T.ArrayType(record, True), True)]
    if dated:
        fields.append(T.StructField(DAY_COL, T.DateType(), True))
    return T.StructType(fields)


def explode_root(df: DataFrame, root: str, record: T.StructType, keep: list[str]) -> DataFrame:
    """Records of an already-read envelope frame (batch or streaming)."""
    return _explode(df, F.col(root), record, [F.col(c) for c in keep])


def _explode(df: DataFrame, root: Column, record: T.StructType, keep: list[Column]) -> DataFrame:
    # posexplode (not the _outer form): an empty or missing array yields no row.
    exploded = df.select(*keep, F.posexplode(root).alias(POS_COL, "__rec"))
    names = [F.col(f"__rec.`{f.name}`").alias(f.name) for f in record.fields]
    rest = [F.col(c) for c in exploded.columns if c != "__rec"]
    return exploded.select(*names, *rest)


def day_folders(spark: SparkSession, path: str, first: dt.date | None, last: dt.date | None,
                days: list[dt.date] | None = None, day_col: str = DAY_COL) -> list[str]:
    """The ``reportdate=`` folders of ``path`` in the range (and among ``days``), from one listing of
    its top level (one entry a day); the files of other days are never listed."""
    want = None if days is None else set(days)
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    out = []
    for status in fs.listStatus(top):
        name = status.getPath().getName()
        key, _, value = name.partition("=")
        if not status.isDirectory() or key != day_col:
            continue
        try:
            day = dt.date.fromisoformat(value)
        except ValueError:
            continue                       # the missing-day folder: in no range
        if (first is None or day >= first) and (last is None or day <= last) and (want is None or day in want):
            out.append(f"{path.rstrip('/')}/{name}")
    return sorted(out)


def read_envelope(spark: SparkSession, path: str, root: str, record: T.StructType,
                  dated: bool = False, mode: str = "FAILFAST", multi_line: bool = True,
                  first_day: dt.date | None = None, last_day: dt.date | None = None,
                  days: list[dt.date] | None = None) -> DataFrame:
    """Records of every envelope under ``path`` as rows.

    Output: the record fields, ``_pos`` (position in its payload), ``_file``, and
    ``reportdate`` (a date, from the partition folder) when ``dated``. A filter on
    ``reportdate`` prunes folders before any file is opened. Malformed JSON fails
    the read (``FAILFAST``) rather than silently dropping the file's records.
    With ``multi_line`` each file is one envelope and one task (not splittable;
    files are API pages, so their size is bounded by the page size). Envelopes
    stored one per line (``multi_line=False``) split like any JSON-lines file.
    ``first_day`` / ``last_day`` / ``days`` read only those day folders, so what is listed is
    bounded by the load and not by the history of the landing zone.
    """
    reader = (spark.read.schema(envelope_schema(root, record, dated))
              .option("multiLine", str(multi_line).lower()).option("mode", mode))
    if first_day is None and last_day is None and days is None:
        raw = reader.json(path)
    else:
        folders = day_folders(spark, path, first_day, last_day, days)
        raw = reader.option("basePath", path).json(folders) if folders else None
    if raw is None:
        fields = [*record.fields, T.StructField(POS_COL, T.IntegerType()), T.StructField(FILE_COL, T.StringType())]
        return spark.createDataFrame([], T.StructType(fields + [T.StructField(DAY_COL, T.DateType())] * dated))
    keep = [F.col("_metadata.file_path").alias(FILE_COL)]
    if dated:
        keep.append(F.col(DAY_COL))
    return _explode(raw, F.col(root), record, keep)


def explode_envelope(df: DataFrame, text_col: str, root: str, record: T.StructType,
                     keep: list[str] | None = None) -> DataFrame:
    """Same as :func:`read_envelope` for envelopes held in a text column.

    ``from_json`` with the declared schema, then ``posexplode`` of the root array;
    ``keep`` columns of ``df`` ride along. Malformed text fails, as it does for files.
    """
    parsed = F.from_json(F.col(text_col), envelope_schema(root, record), {"mode": "FAILFAST"}).getField(root)
    return _explode(df, parsed, record, [F.col(c) for c in (keep or [])])


def explode_records(df: DataFrame, text_col: str, record: T.StructType,
                    keep: list[str] | None = None) -> DataFrame:
    """Records of payloads that are a bare JSON array, without a root key."""
    parsed = F.from_json(F.col(text_col), T.ArrayType(record), {"mode": "FAILFAST"})
    return _explode(df, parsed, record, [F.col(c) for c in (keep or [])])


def read_records(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Records of every file under ``path`` that is one bare JSON array: the record fields,
    ``_pos`` and ``_file``. An empty array gives no rows, malformed text fails."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias(FILE_COL))
    return explode_records(raw, "value", record, [FILE_COL])


def json_field(text_col: str, field: str, ddl_type: str = "string", mode: str = "PERMISSIVE") -> Column:
    """One field of a JSON object held as text, typed by ``ddl_type``. Bad text gives null,
    or fails with ``mode="FAILFAST"``."""
    return F.from_json(F.col(text_col), f"`{field}` {ddl_type}", {"mode": mode}).getField(field)
