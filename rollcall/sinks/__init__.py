"""Sinks: idempotent day append and versioned replace."""

from rollcall.sinks.tables import (  # noqa: F401
    append_day, current_version, drop_days, drop_old_versions, read_days, read_table, recorded_schema, replace_table,
    replace_versioned, rewrite_days,
)
from rollcall.sinks.marks import (  # noqa: F401,E402
    day_marks, day_states, latest_from_marks, marks_ahead, next_day_from_marks, read_marks, refresh_marks,
)
from rollcall.sinks.catalog import (  # noqa: F401,E402
    current_view_version, drop_old_view_versions, read_view, replace_view, view_versions,
)
