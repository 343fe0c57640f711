"""Employee register: normalise the feed, upsert over the stored table (new row wins)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall import schemas
from rollcall.functions import category, remove_first, title_case
from rollcall.operators import bind_by_name, keep_first
from rollcall.sinks import read_table, read_view, replace_versioned, replace_view
from rollcall.sources import FILE_COL, POS_COL, bucket_of, read_envelope
from rollcall.sources.keyed import BUCKET

# Fixed value: suffix removed (first occurrence only) from title-cased designations.
DESIGNATION_SUFFIX = " Ng"


def normalise_employees(feed: DataFrame) -> DataFrame:
    """Drop rows without a name; title-case designation (then strip the first
    ``" Ng"``), division and name; derive ``cat`` from the cleaned designation."""
    named = feed.filter(F.col("emp_name").isNotNull())
    cleaned = named.withColumns({
        "designation": remove_first(title_case("designation"), DESIGNATION_SUFFIX),
        "division": title_case("division"),
        "emp_name": title_case("emp_name"),
    })
    return cleaned.withColumn("cat", category("designation"))


def _page_order(file_col: str) -> list[Column]:
    number = F.regexp_extract(F.col(file_col).cast("string"), r"([0-9]{1,18})(?:\.[A-Za-z.]*)?$", 1).try_cast("long")
    return [F.coalesce(number, F.lit((1 << 63) - 1)).alias("page"), F.col(file_col).cast("string").alias(file_col)]


def merge_employees(new: DataFrame, old: DataFrame | None, key: str = "emp_id",
                    order: tuple[str, ...] = (FILE_COL, POS_COL)) -> DataFrame:
    """Type-1 upsert: new rows first, first row per key kept, whole-row replacement.

    New rows are ordered by page number (the last number in the payload's file name, as
    the landing contract has it; files without one come last, by path) and position;
    stored rows come after all
    new ones (the store keeps no order, so ties among them break on a hash of the
    row). A missing key is one key. Stored rows without a new row stay untouched.
    """
    tagged_new = new.select(
        "*", F.lit(0).alias("__src"),
        F.struct(*[k for c in order for k in (_page_order(c) if c == FILE_COL else [F.col(c).cast("long").alias(c)])]
                 ).alias("__ord"),
        F.lit(None).cast("long").alias("__tie")).drop(*order)
    frames = [tagged_new]
    if old is not None:
        old_cols = [F.col(f"`{c}`") for c in old.columns]
        frames.append(old.select(
            "*", F.lit(1).alias("__src"),
            F.lit(None).cast(tagged_new.schema["__ord"].dataType).alias("__ord"),
            F.xxhash64(*old_cols).alias("__tie")))
    both = bind_by_name(*frames)
    first = keep_first(both, [key], [F.col("__src"), F.col("__ord"), F.col("__tie")])
    return first.drop("__src", "__ord", "__tie")


BUCKETS = 64
_BUCKETED = "employee_by_key"


def _register(warehouse: str, buckets: int) -> str:
    # The count is part of the place: a key is looked for where that count puts it.
    return f"{warehouse}/{_BUCKETED}/of-{buckets}"


def read_register(spark: SparkSession, warehouse: str, buckets: int = BUCKETS,
                  only: list[int] | None = None) -> DataFrame | None:
    """The register that :func:`upsert_buckets` keeps (or its buckets ``only``); ``None`` if there is none."""
    path = _register(warehouse, buckets)
    try:
        whole = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return whole if only is None else whole.filter(F.col(BUCKET).isin(only))


def upsert_buckets(feed: DataFrame, warehouse: str, key: str = "emp_id", buckets: int = BUCKETS) -> list[int]:
    """Merge ``feed`` (normalised, with its file and position) over the register kept in ``buckets`` hash
    buckets of ``key``, reading and rewriting only the buckets that the feed has rows of; returns
    those.

    Buckets are swapped in one after another; a run that fails half way is done again and gives
    the same register, since the feed's rows win either way. A feed that brings a new column
    rewrites all buckets, so that every file holds the same columns; one whose column has
    another type than the stored one raises ``SchemaClash``.
    """
    spark = feed.sparkSession
    place = bucket_of(F.col(key), buckets)
    touched = sorted(r[0] for r in feed.select(place.alias(BUCKET)).distinct().collect())    # ``buckets`` at most
    if not touched:
        return []
    stored = read_register(spark, warehouse, buckets)
    if stored is not None and set(feed.columns) - {FILE_COL, POS_COL} <= set(stored.columns):
        stored = stored.filter(F.col(BUCKET).isin(touched))
    merged = merge_employees(feed, None if stored is None else stored.drop(BUCKET), key)
    (merged.withColumn(BUCKET, place).hint("rebalance", BUCKET).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(_register(warehouse, buckets)))
    return touched


def upsert_employee_buckets(spark: SparkSession, landing: str, warehouse: str, record=schemas.EMPLOYEE,
                            multi_line: bool = True, buckets: int = BUCKETS) -> list[int]:
    """:func:`upsert_employees` on the bucketed register: a small feed costs its own buckets, not the register."""
    feed = read_envelope(spark, f"{landing}/employee", schemas.ROOT_EMPLOYEE, record, multi_line=multi_line)
    return upsert_buckets(normalise_employees(feed), warehouse, buckets=buckets)


def upsert_employees(spark: SparkSession, landing: str, warehouse: str,
                     record=schemas.EMPLOYEE, multi_line: bool = True) -> int:
    """Read the employee feed, normalise, merge over the stored register, and
    write it as the register's next version; returns that version."""
    feed = read_envelope(spark, f"{landing}/employee", schemas.ROOT_EMPLOYEE, record,
                         multi_line=multi_line)
    merged = merge_employees(normalise_employees(feed), read_table(spark, warehouse, "employee"))
    return replace_versioned(merged, warehouse, "employee")


def upsert_employee_view(spark: SparkSession, landing: str, view: str, location: str,
                         record=schemas.EMPLOYEE, multi_line: bool = True) -> int:
    """:func:`upsert_employees` for a register kept in the catalog: read and replaced by its view's name."""
    feed = read_envelope(spark, f"{landing}/employee", schemas.ROOT_EMPLOYEE, record, multi_line=multi_line)
    return replace_view(merge_employees(normalise_employees(feed), read_view(spark, view)), view, location)
