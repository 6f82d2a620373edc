"""The engine's ten types, what they are in Spark, and strict matching of Python values.

Enum and custom values are strings in Spark; which type they have lies in the field's metadata.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import TypeMismatch

INT_RANGE = range(-(1 << 63), 1 << 63)


@dataclass(frozen=True)
class DataType:
    kind: str
    name: str = ""
    variants: tuple[str, ...] = ()

    def __str__(self) -> str:
        if self.kind == "Enum":
            return f"Enum {self.name}({', '.join(self.variants)})"
        return f"Custom {self.name}" if self.kind == "Custom" else self.kind

    @property
    def textual(self) -> bool:
        return self.kind in ("Text", "Enum", "Custom")

    @property
    def numeric(self) -> bool:
        return self.kind in ("Int", "Float")


INT, FLOAT, TEXT, BOOL, BYTES, TIMESTAMP, DATE, TIME, NULL, OTHER = map(DataType, ("Int", "Float", "Text", "Bool", "Bytes", "Timestamp", "Date", "Time", "Null", "Other"))
#: Values of unlike types compare by this order (Int and Float as numbers).
RANK = {k: i for i, k in enumerate(("Null", "Int", "Float", "Text", "Bool", "Bytes", "Timestamp", "Date", "Time", "Enum", "Custom"))}
SPARK = {"Int": T.LongType(), "Float": T.DoubleType(), "Text": T.StringType(), "Bool": T.BooleanType(), "Bytes": T.BinaryType(), "Timestamp": T.TimestampType(), "Date": T.DateType(), "Enum": T.StringType(), "Custom": T.StringType()}
PYTHON = {"Int": int, "Float": float, "Text": str, "Bool": bool, "Bytes": (bytes, bytearray), "Timestamp": dt.datetime, "Date": dt.date, "Time": dt.time, "Enum": str, "Custom": str}
METADATA = "tessera"


def enum(name: str, *variants: str) -> DataType:
    if len(set(variants)) != len(variants):
        raise TypeMismatch("distinct variants", variants)
    return DataType("Enum", name, tuple(variants))


def custom(name: str) -> DataType:
    return DataType("Custom", name)


def to_spark(t: DataType) -> T.DataType:
    return T.TimeType() if t.kind == "Time" else SPARK[t.kind]


def of_field(f: T.StructField) -> DataType:
    """The engine's type of a Spark field. Narrow integers are Int, decimals and float Float; nested types are carried along as Other."""
    if own := (f.metadata or {}).get(METADATA):
        return from_json(own)
    d = f.dataType
    if isinstance(d, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(d, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(d, (T.TimestampType, T.TimestampNTZType)):
        return TIMESTAMP
    if d.typeName().startswith("time("):
        return TIME
    return next((DataType(k) for k, s in SPARK.items() if k not in ("Enum", "Custom") and type(s) is type(d)), NULL if isinstance(d, T.NullType) else OTHER)


def to_json(t: DataType) -> str:
    return json.dumps([t.kind, t.name, list(t.variants)])


def from_json(s: str) -> DataType:
    kind, name, variants = json.loads(s)
    return DataType(kind, name, tuple(variants))


def of_value(v: object) -> DataType:
    """The type of a Python value; bool before int, datetime before date."""
    if v is None:
        return NULL
    for kind in ("Bool", "Int", "Float", "Text", "Bytes", "Timestamp", "Date", "Time"):
        if isinstance(v, PYTHON[kind]):
            return DataType(kind)
    raise TypeMismatch("a value of the engine", type(v).__name__)


def check(v: object, t: DataType, column: str = "") -> None:
    """Raises unless v is null or a value of just type t: nothing is coerced, not even Int to Float."""
    if v is None:
        return
    ok = isinstance(v, PYTHON[t.kind]) and not (t.kind == "Int" and isinstance(v, bool)) and not (t.kind == "Date" and isinstance(v, dt.datetime))
    if not ok or t.kind == "Int" and v not in INT_RANGE or t.kind == "Enum" and v not in t.variants:
        raise TypeMismatch(f"{t} in column {column}" if column else t, repr(v))
