"""Request manifests: the relative path of each payload to fetch, and which are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.dates import iso_text


def request_manifest(keys: DataFrame, feed: str, day_col: str | None = None,
                     key_col: str | None = None, key_name: str = "key",
                     name: str = "path", total_col: str | None = None, page_size: int = 1000) -> DataFrame:
    """Distinct ``<feed>/reportdate=YYYY-MM-DD[/<key_name>=<key>]`` paths.

    With ``total_col`` (records of that day or key) one path per page follows:
    ``.../offset=<o>/count=<page_size>`` for o = 0, page_size, ... below the total; a total
    of 0 still asks for the first page, a missing one gives a missing path.

    ``keys`` is a day spine, a frame of keys, or both (a day and a key per row).
    A missing day or key gives a missing path (``concat`` is null-propagating), never
    the text ``NA`` inside a path.
    """
    parts = [F.lit(feed)]
    if day_col:
        parts += [F.lit("/reportdate="), iso_text(F.col(day_col))]
    if key_col:
        parts += [F.lit(f"/{key_name}="), F.col(key_col).cast("string")]
    if total_col:
        total = F.col(total_col).cast("long")
        last = F.when(total.isNotNull(), F.greatest(total - 1, F.lit(0).cast("long")))
        offsets = F.sequence(F.lit(0).cast("long"), last, F.lit(page_size).cast("long"))
        keys = keys.select("*", F.explode_outer(offsets).alias("__offset"))
        parts += [F.lit("/offset="), F.col("__offset").cast("string"), F.lit(f"/count={page_size}")]
    return keys.select(F.concat(*parts).alias(name)).distinct()


def not_landed(manifest: DataFrame, landed: DataFrame, on: str = "path") -> DataFrame:
    """Manifest entries with no landed counterpart (anti join; both sides one column)."""
    return manifest.join(landed.select(on).distinct(), on, "left_anti")
