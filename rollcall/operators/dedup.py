"""Duplicate removal: distinct keys over several columns, and keyed keep-first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, cols: Sequence[str], exclude: object = "",
                  name: str = "key") -> DataFrame:
    """Distinct values found in any of ``cols`` (one scan: the columns are exploded
    side by side), minus the sentinel ``exclude``. A missing value is one key and is
    kept: the sentinel test is null-safe, so ``null`` is not dropped with ``""``.
    """
    if len(cols) == 1:
        keys = df.select(F.col(cols[0]).alias(name))
    else:
        keys = df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias(name))
    keys = keys.distinct()
    if exclude is not None:
        keys = keys.filter(~F.col(name).eqNullSafe(F.lit(exclude)))
    return keys


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first by ``order``. A missing key is one group.

    ``row_number() = 1`` plans as a partial ``WindowGroupLimit`` before the shuffle
    and a final one after, so a hot key ships at most one row per map task.
    ``order`` must be total (ties make the winner arbitrary).
    """
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")
