"""Scans by key: a source laid out in hash buckets of its key, of which only those in use are read.

The source system answers one request per distinct key; the landed counterpart is one folder
per bucket. The buckets of the keys in use (a set no larger than the number of buckets, so
its broadcast is bounded) prune the folders when the query runs, before a file is opened;
the key itself is then matched by a semi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.joins import lookup_keys

BUCKET = "bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket of a key in ``[0, buckets)``; missing keys have one bucket too."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _place(path: str, buckets: int) -> str:
    return f"{path.rstrip('/')}/of-{buckets}"


def land_by_key(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``df`` under ``path`` in ``buckets`` hash buckets of ``key``, replacing what was there."""
    (df.withColumn(BUCKET, bucket_of(F.col(key), buckets)).hint("rebalance", BUCKET).write.mode("overwrite")
     .option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(_place(path, buckets)))


def keyed_scan(spark: SparkSession, path: str, key: str, keys: DataFrame, buckets: int) -> DataFrame:
    """Rows of the source that :func:`land_by_key` wrote whose ``key`` is among ``keys`` (first column, null-safe):
    the rows that :func:`lookup_keys` gives, read from the buckets of those keys alone."""
    used = keys.select(bucket_of(F.col(keys.columns[0]), buckets).alias("__bucket"))
    used = F.broadcast(used.filter(F.col("__bucket") >= 0).distinct())               # ``buckets`` rows at most
    source = spark.read.parquet(_place(path, buckets))
    there = source.join(used, source[BUCKET] == used["__bucket"], "left_semi").drop(BUCKET)
    return lookup_keys(there, key, keys)
