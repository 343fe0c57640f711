"""The daily loads, each independent: attendance, leave/tour, employees, holidays, latest date."""

from rollcall.plans.attendance import (  # noqa: F401
    LoadStatus, adopt_table, device_keys, device_locations, enrich_attendance, load_attendance,
    load_days, next_attendance_day,
)
from rollcall.plans.dashboard import latest_loaded_date  # noqa: F401
from rollcall.plans.employees import (  # noqa: F401
    merge_employees, normalise_employees, read_register, upsert_buckets, upsert_employee_buckets, upsert_employee_view,
    upsert_employees,
)
from rollcall.plans.holidays import replace_holidays  # noqa: F401
from rollcall.plans.leave import (  # noqa: F401
    covered_days, leave_history, leave_window, read_leave, refresh_leave, refresh_leave_days,
)
