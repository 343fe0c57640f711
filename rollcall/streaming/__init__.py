"""Structured Streaming form of the attendance load."""

from rollcall.streaming.attendance import landed_days, run_attendance_stream  # noqa: F401
