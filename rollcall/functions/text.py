"""Text expressions: Unicode title case and removal of the first literal match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions._cols import as_col


def title_case(c: Column | str) -> Column:
    """Lower-case, then capitalise each word, with words split at Unicode word breaks.

    ``-``, ``/`` and ``(`` start a new word; ``'`` and ``.`` between letters do not
    (``ENT/EYE (OLD)`` -> ``Ent/Eye (Old)``). Plain ``initcap`` only splits at spaces,
    so the value is compared under the ICU ``UNICODE`` collation, which makes
    ``initcap`` use ICU word breaks. The result is collated back to the default
    binary collation so it never leaks a collated type into joins or files.
    Null stays null.
    """
    return F.collate(F.initcap(F.collate(as_col(c), "UNICODE")), "UTF8_BINARY")


def remove_first(c: Column | str, literal: str) -> Column:
    """Remove the first occurrence of ``literal`` (case-sensitive, may be mid-word).

    Uses ``locate`` + ``overlay`` rather than a regex: a plain ``regexp_replace``
    would remove every match. Null stays null; no match leaves the value as is.
    """
    if not literal:
        return as_col(c)
    col = as_col(c)
    pos = F.locate(literal, col)
    return F.when(pos > 0, F.overlay(col, F.lit(""), pos, F.lit(len(literal)))).otherwise(col)
