"""DataFrame -> DataFrame operators."""

from rollcall.operators.dedup import distinct_keys, keep_first  # noqa: F401
from rollcall.operators.joins import (  # noqa: F401
    fits_broadcast, hot_keys, left_join_null_safe, lookup_keys, maybe_broadcast, role_join,
)
from rollcall.operators.marks import date_spine, has_rows, latest_date, next_load_date  # noqa: F401
from rollcall.operators.union import SchemaClash, bind_by_name, merge_schemas  # noqa: F401
