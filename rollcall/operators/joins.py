"""Null-safe left joins against a dimension, one or several roles, with a checked broadcast.

The dimension is broadcast only after an exact size check (one distributed
aggregate over the projected dimension); past the bound the join is left to Spark
(sort-merge with AQE skew splitting of hot fact keys, the null key included).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Broadcast bound on the dimension's estimated in-memory (UnsafeRow) bytes.
DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024
_CONF_KEY = "rollcall.broadcast.maxBytes"

_VAR_TYPES = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _row_bytes(df: DataFrame):
    """UnsafeRow size of a row: null bitset + 8 bytes per field + 8-aligned variable data."""
    fields = df.schema.fields
    fixed = 8 * ((len(fields) + 63) // 64) + 8 * len(fields)
    total = F.lit(fixed).cast("long")
    for f in fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            n = F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
            total = total + ((n + 7) / 8).cast("long") * 8
        elif isinstance(f.dataType, _VAR_TYPES):
            n = F.coalesce(F.octet_length(F.to_json(F.col(f"`{f.name}`"))), F.lit(0))
            total = total + n.cast("long") * 2
    return total


def broadcast_bound(df: DataFrame) -> int:
    spark = df.sparkSession
    return int(spark.conf.get(_CONF_KEY, str(DEFAULT_BROADCAST_BYTES)))


def fits_broadcast(df: DataFrame, max_bytes: int | None = None) -> bool:
    """Exact check that ``df`` is small enough to broadcast.

    Runs one aggregate (partial per task, one row to the driver): row count and
    summed row size. Nothing but two numbers leaves the executors.
    """
    bound = broadcast_bound(df) if max_bytes is None else max_bytes
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df)).alias("b")).first()
    size = int(stats["b"] or 0) + 64 * int(stats["n"] or 0)   # + hash-table overhead per row
    return size <= bound


def maybe_broadcast(df: DataFrame, max_bytes: int | None = None, check: bool = True) -> DataFrame:
    """``broadcast(df)`` when its size is proven under the bound, else ``df`` unchanged."""
    if check and fits_broadcast(df, max_bytes):
        return F.broadcast(df)
    return df


def hot_keys(fact: DataFrame, key: str, share: float = 0.01, total: int | None = None) -> DataFrame:
    """Keys (the missing key included) holding more than ``share`` of ``fact``'s rows.

    One pass over the key column with map-side partial counts, against the row count
    ``total`` (counted here if not given). Only the hot keys are materialised, with
    ``checkpoint()`` (reliable, in the shared checkpoint folder), so the joins that use
    them do not plan the fact again. At most ``1/share`` keys can qualify: a proven
    bound, so the result is broadcast.
    """
    from rollcall.session import shared_dir
    shared_dir(fact.sparkSession)                       # checkpoint() needs the folder set
    n = fact.count() if total is None else total
    counts = fact.groupBy(F.col(key).alias("__hot_key")).agg(F.count(F.lit(1)).alias("__n"))
    return counts.filter(F.col("__n") > F.lit(share * n)).select("__hot_key").checkpoint()


def left_join_null_safe(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                        broadcast: bool | None = None, salt_buckets: int = 0,
                        hot_share: float = 0.01, hot: DataFrame | None = None) -> DataFrame:
    """Keep every fact row; missing keys match missing keys; duplicate dim keys multiply rows.

    The dimension's key column is not in the output. ``broadcast=None`` checks the
    size, ``True`` forces it (caller proved the bound), ``False`` never broadcasts.

    When the join is not broadcast, hot fact keys are split by AQE's skew join by
    default. ``salt_buckets=S`` splits them explicitly instead (useful with AQE off
    or below its thresholds): rows of keys holding more than ``hot_share`` of the
    fact get a salt in ``[0, S)`` from a hash of the row (stable across task
    retries), the dimension rows of those keys are repeated once per salt, and
    the join also matches on the salt. Other keys keep salt 0 and are not copied.
    ``hot`` passes hot keys computed earlier (one ``__hot_key`` column).
    """
    tmp = "__dim_key"
    d = dim.withColumnRenamed(dim_key, tmp)
    if broadcast is None:
        broadcast = fits_broadcast(d)
    if broadcast:
        bd = F.broadcast(d)
        return fact.join(bd, fact[fact_key].eqNullSafe(bd[tmp]), "left").drop(tmp)
    if salt_buckets and salt_buckets > 1:
        if hot is None:
            hot = hot_keys(fact, fact_key, hot_share)
        return _salted_left_join(fact, d, fact_key, tmp, salt_buckets, hot)
    cond = fact[fact_key].eqNullSafe(d[tmp])
    return fact.join(d.hint("merge"), cond, "left").drop(tmp)


def _salted_left_join(fact: DataFrame, d: DataFrame, fact_key: str, tmp: str,
                      buckets: int, hot_keys_df: DataFrame) -> DataFrame:
    hot = F.broadcast(hot_keys_df.withColumn("__hot", F.lit(True)))
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in fact.columns])
    f = (fact.join(hot, fact[fact_key].eqNullSafe(hot["__hot_key"]), "left")
             .withColumn("__salt", F.when(F.col("__hot"), F.pmod(row_hash, F.lit(buckets)))
                                     .otherwise(F.lit(0).cast("long")))
             .drop("__hot_key", "__hot"))
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))) \
              .otherwise(F.array(F.lit(0).cast("long")))
    dd = (d.join(hot, d[tmp].eqNullSafe(hot["__hot_key"]), "left")
           .withColumn("__dsalt", F.explode(copies))
           .drop("__hot_key", "__hot"))
    cond = f[fact_key].eqNullSafe(dd[tmp]) & (f["__salt"] == dd["__dsalt"])
    return f.join(dd.hint("merge"), cond, "left").drop(tmp, "__salt", "__dsalt")


def role_join(fact: DataFrame, dim: DataFrame, roles: Mapping[str, str], dim_key: str,
              value: str, dedupe_dim: bool = False, broadcast: bool | None = None,
              salt_buckets: int = 0, hot_share: float = 0.01) -> DataFrame:
    """Join one projected dimension once per role: ``{fact_key: output_column}``.

    Every fact row is kept; a dimension key listed twice doubles the rows of each
    role it matches (so up to four copies over two roles). ``dedupe_dim=True``
    drops exact duplicate (key, value) pairs first. The size check runs once, and
    every role joins the same projection (renamed only after the join), so the
    plan builds one broadcast and reuses it for each role.
    """
    d = dim.select(F.col(dim_key).alias("__dim_key"), F.col(value).alias("__dim_value"))
    if dedupe_dim:
        d = d.distinct()
    if broadcast is None:
        broadcast = fits_broadcast(d)
    salting = not broadcast and salt_buckets > 1
    if salting and fact.isStreaming:
        raise ValueError("salt_buckets needs a batch fact: hot keys are counted up front, "
                         "which a stream cannot do; broadcast the dimension instead")
    # Hot keys of every role come from the original fact, not from the previous
    # role's join output (which would re-plan the whole fact once more per role).
    total = fact.count() if salting else 0
    hot = {k: hot_keys(fact, k, hot_share, total) for k in roles} if salting else {}
    out = fact
    for fact_key, out_name in roles.items():
        out = left_join_null_safe(out, d, fact_key, "__dim_key", broadcast=broadcast,
                                  salt_buckets=salt_buckets, hot=hot.get(fact_key))
        out = out.withColumnRenamed("__dim_value", out_name)
    return out


def lookup_keys(dim: DataFrame, key: str, keys: DataFrame, keys_col: str | None = None,
                broadcast: bool | None = None) -> DataFrame:
    """Rows of ``dim`` whose ``key`` is among ``keys`` (null-safe), dimension columns only.

    ``keys`` is usually derived from the fact (distinct ids), so checking its size
    up front would scan the fact twice. By default (``None``) the choice is left
    to AQE, which broadcasts the key side only after its shuffle has run and its
    real size is known; ``True`` forces a broadcast the caller has bounded.
    """
    kc = keys_col or keys.columns[0]
    k = keys.select(F.col(kc).alias("__lookup_key"))
    if broadcast:
        k = F.broadcast(k)
    return dim.join(k, dim[key].eqNullSafe(k["__lookup_key"]), "left_semi")
