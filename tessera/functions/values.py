"""Casts as Spark columns, typed access to collected values, and client-side dates and times."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import types as t
from ..errors import ConversionError
from ..types import DataType

MOST, LEAST = (1 << 63) - 1, -(1 << 63)
#: The only texts that are booleans.
TRUE_TEXTS, FALSE_TEXTS = ("true", "1", "t"), ("false", "0", "f")


def _fail(kind: DataType, c: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"not a value of {kind}: "), c.cast("string")))


def cast_expr(c: Column, source: DataType, target: DataType) -> Column:
    """c of type source as target; pairs not listed are an error at once, values that don't fit at evaluation. Null stays null."""
    a, b = source.kind, target.kind
    if a == "Null":
        return c.cast(t.to_spark(target))
    if a == b and a in ("Int", "Float", "Text", "Bool"):
        return c
    if (a, b) == ("Int", "Float"):
        return c.cast("double")
    if (a, b) == ("Float", "Int"):  # toward zero, saturating, NaN to 0
        inside = (c < float(1 << 63)) & (c > float(LEAST)) & ~F.isnan(c)
        # the inner choice keeps the cast's argument in range whatever is evaluated first
        return F.when(inside, F.when(inside, c).otherwise(0.0).cast("bigint")).when(F.isnan(c), F.lit(0).cast("bigint")).when(c > 0, F.lit(MOST)).when(c < 0, F.lit(LEAST))
    if b == "Text" and a in ("Int", "Float", "Bool"):
        return c.cast("string")
    if a == "Text":
        if b in ("Int", "Float"):
            return F.trim(c).cast(t.to_spark(target))
        if b == "Bool":
            return F.when(c.isNull(), F.lit(None).cast("boolean")).when(c.isin(*TRUE_TEXTS), F.lit(True)).when(c.isin(*FALSE_TEXTS), F.lit(False)).otherwise(_fail(target, c).cast("boolean"))
        if b == "Date":
            return F.to_date(c, "yyyy-MM-dd")
        if b == "Time":
            return F.when(c.isNull() | c.rlike(r"\A\d{2}:\d{2}(:\d{2}(\.\d+)?)?\z"), c).otherwise(_fail(target, c)).cast("time")
        if b == "Enum":
            return F.when(c.isNull() | c.isin(*target.variants), c).otherwise(_fail(target, c))
        if b == "Custom":
            return c
    raise ConversionError(target, source)


def from_row(value: object, target: DataType) -> object:
    """A collected value as a Python value of just that type; null gives None."""
    if value is None:
        return None
    if target.kind == "Bytes" and isinstance(value, bytearray):
        value = bytes(value)
    try:
        t.check(value, target)
    except t.TypeMismatch:
        raise ConversionError(target, type(value).__name__) from None
    return value


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def today(zone: str | None = None) -> dt.date:
    return date_of(now(), zone)


def current_time(zone: str | None = None) -> dt.time:
    return time_of(now(), zone)


def _local(ts: dt.datetime, zone: str | None) -> dt.datetime:
    ts = ts if ts.tzinfo else ts.replace(tzinfo=dt.timezone.utc)
    return ts.astimezone(ZoneInfo(zone) if zone else None)


def date_of(ts: dt.datetime, zone: str | None = None) -> dt.date:
    """The date in a zone, without one in the local zone; naive timestamps are UTC."""
    return _local(ts, zone).date()


def time_of(ts: dt.datetime, zone: str | None = None) -> dt.time:
    return _local(ts, zone).time()


def parse_date(text: str) -> dt.date:
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError:
        raise ConversionError(t.DATE, text) from None


def parse_time(text: str) -> dt.time:
    """HH:MM:SS or HH:MM."""
    if not re.fullmatch(r"\d{1,2}:\d{2}(:\d{2})?", text):
        raise ConversionError(t.TIME, text)
    try:
        return dt.time(*map(int, text.split(":")))
    except ValueError:
        raise ConversionError(t.TIME, text) from None


@dataclass(frozen=True)
class TimestampParts:
    utc: dt.datetime
    zone: str
    local_date: dt.date
    local_time: dt.time

    @property
    def formatted_date(self) -> str:
        return self.local_date.strftime("%Y-%m-%d")

    @property
    def formatted_time(self) -> str:
        return self.local_time.strftime("%H:%M:%S")

    def receipt(self) -> str:
        return f"{self.formatted_date} {self.formatted_time} {self.zone}"


def timestamp_parts(ts: dt.datetime, zone: str | None = None) -> TimestampParts:
    local = _local(ts, zone)
    return TimestampParts(local.astimezone(dt.timezone.utc), local.tzname() or "UTC", local.date(), local.time().replace(tzinfo=None))
