"""Conversions between types, and constructors of dates and times."""

from .values import cast_expr, current_time, date_of, from_row, now, parse_date, parse_time, time_of, timestamp_parts, today

__all__ = ["cast_expr", "current_time", "date_of", "from_row", "now", "parse_date", "parse_time", "time_of", "timestamp_parts", "today"]
