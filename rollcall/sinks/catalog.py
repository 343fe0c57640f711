"""Replaced tables by name: one catalog table a version, and a view that names the current one.

The counterpart of ``replace_table`` for sessions with a catalog: each replace writes a
complete table ``<name>__v<n>`` and then points the view ``<name>`` at it in one statement, so a
table may be rebuilt from itself by its own name, readers switch in one step, and there
is no log besides the catalog. How long names live is the catalog's affair: with a shared
metastore all sessions see them, with Spark's built-in catalog only the session itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_VERSION = "__v"


def _quoted(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def _parts(name: str) -> tuple[str | None, str]:
    database, _, table = name.rpartition(".")
    return database or None, table


def view_versions(spark: SparkSession, name: str) -> list[int]:
    """Numbers of the versions of ``name`` that are in the catalog, the uncommitted one of a failed
    replace among them."""
    database, table = _parts(name)
    pattern = re.compile(re.escape(table.lower() + _VERSION) + r"(\d+)")
    found = spark.catalog.listTables(database, pattern=f"{table}{_VERSION}*")
    return sorted(int(m.group(1)) for t in found if (m := pattern.fullmatch(t.name.lower())))


def current_view_version(spark: SparkSession, name: str) -> int | None:
    """The version the view shows; ``None`` without a view."""
    if not spark.catalog.tableExists(name):
        return None
    text = spark.sql(f"SHOW CREATE TABLE {_quoted(name)}").first()[0]
    found = re.search(re.escape(_parts(name)[1] + _VERSION) + r"(\d+)", text, re.IGNORECASE)
    return int(found.group(1)) if found else None


def replace_view(df: DataFrame, name: str, location: str) -> int:
    """Write ``df`` as the next version of ``name`` (files under ``location``) and show it; returns the version.

    The view changes only after the version is written whole. One writer a name is assumed.
    """
    spark = df.sparkSession
    shown = current_view_version(spark, name) or 0
    version = shown + 1
    table = f"{name}{_VERSION}{version:06d}"
    if spark.catalog.tableExists(table):                       # left by a replace that failed before its view
        spark.sql(f"DROP TABLE {_quoted(table)}")
    (df.write.mode("overwrite").option("path", f"{location.rstrip('/')}/v{version:06d}").format("parquet")
     .saveAsTable(_quoted(table)))
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(name)} AS SELECT * FROM {_quoted(table)}")
    return version


def read_view(spark: SparkSession, name: str) -> DataFrame | None:
    """The current version of ``name``, or ``None`` if it was never written."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def drop_old_view_versions(spark: SparkSession, name: str, location: str, keep: int) -> list[int]:
    """Drop all but the newest ``keep`` versions up to the shown one, files included; returns which."""
    if keep < 1:
        raise ValueError("the current version must stay")
    shown = current_view_version(spark, name)
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for v in (view_versions(spark, name) if shown else ()):
        if v <= shown - keep:
            spark.sql(f"DROP TABLE {_quoted(f'{name}{_VERSION}{v:06d}')}")
            path = jvm.org.apache.hadoop.fs.Path(f"{location.rstrip('/')}/v{v:06d}")
            path.getFileSystem(conf).delete(path, True)
            gone.append(v)
    return gone
