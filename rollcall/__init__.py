"""rollcall: attendance and HR data loads expressed as Spark DataFrame plans.

Sub-packages:
  functions  -- column expressions (title case, first-match removal, dates, categories)
  operators  -- DataFrame -> DataFrame building blocks (joins, keep-first, union by name, marks)
  sources    -- JSON envelope landing-zone readers, key lookups, request manifests
  sinks      -- idempotent day-partition append and versioned whole-table replace
  plans      -- the daily loads (attendance, leave/tour, employees, holidays, latest date)
  streaming  -- the attendance load as an availableNow file stream
"""

__version__ = "0.1.0"
