"""What has landed, from file names, sizes and times alone: no file is opened.

A dated feed's folder is listed by Spark (day folders in parallel) as a ``binaryFile``
frame of which only ``_metadata`` is read. From it come one fingerprint a day (a day whose
files differ from what a load read has a late, corrected or withdrawn page) and the pages
that a manifest asks for and no file holds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.dates import iso_text
from rollcall.sources.envelope import DAY_COL, day_folders

FILES = f"{DAY_COL} date, file string, bytes long, modified timestamp"
PRINT = "files long, bytes long, digest long"


def landed_files(spark: SparkSession, path: str, first_day: dt.date | None = None, last_day: dt.date | None = None,
                 days: list[dt.date] | None = None) -> DataFrame:
    """One row a landed file of the chosen day folders: ``reportdate, file, bytes, modified``; ``file`` is
    its path within the day's folder."""
    folders = day_folders(spark, path, first_day, last_day, days)
    if not folders:
        return spark.createDataFrame([], FILES)
    raw = spark.read.format("binaryFile").option("basePath", path).load(folders)
    return raw.select(F.col(DAY_COL).cast("date").alias(DAY_COL),
                      F.regexp_extract("_metadata.file_path", f"/{DAY_COL}=[^/]*/(.*)$", 1).alias("file"),
                      F.col("_metadata.file_size").alias("bytes"),
                      F.col("_metadata.file_modification_time").alias("modified"))


def fingerprints(files: DataFrame, *keys: str) -> DataFrame:
    """Per day (and ``keys``): the number of files, their bytes, and a digest of names, sizes
    and times that does not depend on their order."""
    one = F.xxhash64("file", "bytes", F.unix_micros("modified"))
    return files.groupBy(DAY_COL, *keys).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"),
                                             F.bit_xor(one).alias("digest"))


def landed_days(spark: SparkSession, path: str, first_day: dt.date | None = None, last_day: dt.date | None = None,
                days: list[dt.date] | None = None) -> DataFrame:
    """The fingerprint of every landed day, as of this call: one row a day, held by the driver, so that
    files that land during the load do not pass for read."""
    now = fingerprints(landed_files(spark, path, first_day, last_day, days)).filter(F.col(DAY_COL).isNotNull())
    return spark.createDataFrame(now.collect(), f"{DAY_COL} date, {PRINT}")            # one row a day


def page_number(file: str | Column, page_size: int = 1000, first_page: int = 0) -> Column:
    """The page a landed file holds: by its ``offset=`` folder if it landed under the manifest's
    path, else by the last number in its name; null without one."""
    name = F.col(file) if isinstance(file, str) else file
    offset = F.regexp_extract(name, r"(?:^|/)offset=([0-9]{1,18})/", 1).try_cast("long")
    number = F.regexp_extract(name, r"([0-9]{1,18})(?:\.[A-Za-z.]*)?$", 1).try_cast("long")
    return F.coalesce(F.floor(offset / page_size) + first_page, number)


def paged_manifest(totals: DataFrame, feed: str, page_size: int = 1000, first_page: int = 0,
                   day_col: str = DAY_COL, total_col: str = "total") -> DataFrame:
    """One row a page that each day should have: ``reportdate, page, path``, the path as
    :func:`rollcall.sources.request_manifest` writes it. ``totals`` has the records of each day; a total of 0
    still asks for one page, and a missing total gives one row with a missing page, which
    nothing that lands can satisfy."""
    total = F.col(total_col).cast("long")
    last = F.when(total.isNotNull(), F.greatest(total - 1, F.lit(0).cast("long")))
    offsets = F.sequence(F.lit(0).cast("long"), last, F.lit(page_size).cast("long"))
    day = F.col(day_col).cast("date")
    pages = totals.select(day.alias(DAY_COL), F.explode_outer(offsets).alias("__offset")).distinct()
    path = F.concat(F.lit(f"{feed}/reportdate="), iso_text(DAY_COL), F.lit("/offset="),
                    F.col("__offset").cast("string"), F.lit(f"/count={page_size}"))
    return pages.select(DAY_COL, (F.expr(f"__offset div {page_size}") + F.lit(first_page)).alias("page"), path.alias("path"))


def completeness(manifest: DataFrame, files: DataFrame, page_size: int = 1000, first_page: int = 0) -> DataFrame:
    """Per day of the paged ``manifest``: ``pages`` asked for, ``landed`` ones among them, the numbers
    of the ``missing`` ones, and whether the day is ``whole``."""
    have = files.select(DAY_COL, page_number("file", page_size, first_page).alias("page")).distinct().withColumn("__have", F.lit(True))
    got = manifest.join(have, [DAY_COL, "page"], "left")
    out = got.groupBy(DAY_COL).agg(
        F.count(F.lit(1)).alias("pages"), F.count("__have").alias("landed"),
        F.sort_array(F.collect_list(F.when(F.col("__have").isNull(), F.col("page")))).alias("missing"))
    return out.withColumn("whole", F.col("pages") == F.col("landed"))
