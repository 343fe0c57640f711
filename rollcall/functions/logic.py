"""Conditional expressions with R-style missing-value rules, and the staff category."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions._cols import as_col

# Fixed values (must equal the source system's for the same results).
# Designation -> staff category, tested in this order; anything else, missing
# included, is "Other".
CATEGORY_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Faculty", ("Assistant Professor", "Statistician", "Associate Professor", "Professor")),
    ("Junior Resident", ("Junior Resident", "Tutor")),
    ("Senior Resident", ("Senior Resident",)),
)
CATEGORY_DEFAULT = "Other"


def if_else(cond: Column, yes: Column | str, no: Column | str) -> Column:
    """Two-way choice where a missing condition gives a missing result.

    ``when(c, a).otherwise(b)`` would send a null condition to ``b``; two explicit
    branches and no ``otherwise`` keep it null.
    """
    yes_c = as_col(yes) if isinstance(yes, Column) else F.lit(yes)
    no_c = as_col(no) if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes_c).when(~cond, no_c)


def category(c: Column | str,
             rules: Sequence[tuple[str, Sequence[str]]] | Mapping[str, Sequence[str]] = CATEGORY_RULES,
             default: str | None = CATEGORY_DEFAULT) -> Column:
    """First rule whose value list contains ``c`` wins; a missing value matches no rule."""
    items = list(rules.items()) if isinstance(rules, Mapping) else list(rules)
    if not items:
        return F.lit(default)
    col = as_col(c)
    out = None
    for label, values in items:
        test = col.isin(list(values))
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))
