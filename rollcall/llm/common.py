"""Shared helpers: tables, row ids, scratch tables in the shared folder, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.joins import broadcast_bound, maybe_broadcast
from rollcall.session import scratch_path

RID = "__rid"
ROW = "__row"
# White space of the word contracts: space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint folder and read it back.

    This cuts lineage on storage every executor reaches, so a lost executor costs
    only its running tasks, and values that depend on the task that made them
    (row ids) are fixed.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rid(df: DataFrame) -> DataFrame:
    """Add a row id; stable only once written, so follow with :func:`materialize`."""
    return df.withColumn(RID, F.monotonically_increasing_id())


def packed(docs: DataFrame, *extra: Column, columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` of ``docs`` (default all) in one struct, where no name of theirs can
    clash, plus ``extra``."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)])
    return docs.select(row.alias(ROW), *extra)


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in columns])


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(m)


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) hashed from ``cols``: the same in every run and retry."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 12)
    return (bits + F.lit(0.5)) * F.lit(2.0 ** -52)


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Rows an Arrow batch from here on: few for whole texts, so that a batch fits a worker,
    many for short rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def reader_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows a batch of Spark's Parquet reader in this block: few for whole texts, as the reader
    holds a batch of them, and up to twice its bytes while it grows, in each task."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Broadcast ``df`` if its measured size is under the library's bound, and ``max_bytes`` if
    given; else leave the join to Spark (sort-merge, skewed keys split by AQE)."""
    return maybe_broadcast(df, None if max_bytes is None else min(max_bytes, broadcast_bound(df)))
