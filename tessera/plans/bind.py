"""Binding: (expression, columns in scope) to (Spark column, engine type). All semantics that differ from Spark's own are here."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as t
from ..errors import ColumnNotFound, InvalidExpression
from ..expr import Binary, Col, ColIdx, Expr, InList, IsNotNull, IsNull, Lit, Not
from ..types import DataType

COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul}
#: An escape character that no pattern has: backslash stays a plain character, and `a%` is still pushed down as a prefix.
NO_ESCAPE = "\x01"


@dataclass(frozen=True)
class Bound:
    column: Column
    type: DataType
    zoned: bool = True  # of a timestamp


@dataclass(frozen=True)
class Scope:
    """Columns by place: (name, type, zoned)."""

    fields: tuple[tuple[str, DataType, bool], ...]
    line_like: bool = False  # LIKE does not cross line ends

    @classmethod
    def of(cls, df: DataFrame, hidden: tuple[str, ...] = (), line_like: bool = False) -> Scope:
        return cls(tuple((f.name, t.of_field(f), not isinstance(f.dataType, T.TimestampNTZType)) for f in df.schema.fields if f.name not in hidden), line_like)

    def find(self, name: str) -> tuple[str, DataType, bool]:
        for f in self.fields:
            if f[0].lower() == name.lower():
                return f
        raise ColumnNotFound(name)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def literal(e: Lit) -> Column:
    if e.value is None:
        return F.lit(None)
    return F.lit(bytes(e.value) if e.type.kind == "Bytes" else e.value).cast(t.to_spark(e.type))


def _field(f: tuple[str, DataType, bool]) -> Bound:
    name, kind, zoned = f
    c = quoted(name)
    if kind is t.INT:
        c = c.cast("bigint")
    elif kind is t.FLOAT:
        c = c.cast("double")
    return Bound(c, kind, zoned)


def _same(a: Bound, b: Bound) -> tuple[Column, Column]:
    """Columns of two bound timestamps, made alike."""
    if a.type.kind == b.type.kind == "Timestamp" and a.zoned != b.zoned:
        return a.column.cast("timestamp_ntz"), b.column.cast("timestamp_ntz")
    return a.column, b.column


def compare(op: str, a: Bound, b: Bound) -> Column:
    f = COMPARE[op]
    if t.NULL in (a.type, b.type):
        return _null("boolean")
    if t.OTHER in (a.type, b.type):
        raise InvalidExpression(f"columns of nested types cannot be compared ({op})")
    named = a.type.kind in ("Enum", "Custom")
    if a.type.numeric and b.type.numeric or a.type.kind == b.type.kind and (not named or a.type.name == b.type.name):
        return f(*_same(a, b))
    order = lambda x: (t.RANK[x.kind], x.name)
    return F.when(a.column.isNull() | b.column.isNull(), _null("boolean")).otherwise(F.lit(bool(f(order(a.type), order(b.type)))))


def _truth(b: Bound, what: str) -> Column:
    if b.type is t.NULL:
        return _null("boolean")
    if b.type.kind != "Bool":
        raise InvalidExpression(f"{what} needs a boolean, not {b.type}")
    return b.column


def arithmetic(op: str, a: Bound, b: Bound) -> Bound:
    for x in (a, b):
        if not (x.type.numeric or x.type is t.NULL):
            raise InvalidExpression(f"{op} needs numbers, not {x.type}")
    if t.NULL in (a.type, b.type):
        other = a.type if b.type is t.NULL else b.type
        kind = t.INT if other is t.NULL else other
        return Bound(_null(t.to_spark(kind).simpleString()), kind)
    both = a.type.kind == b.type.kind == "Int"
    if op == "/":
        return Bound(F.call_function("div", a.column, b.column), t.INT) if both else Bound(a.column.cast("double") / b.column.cast("double"), t.FLOAT)
    return Bound(ARITHMETIC[op](a.column, b.column), t.INT if both else t.FLOAT)


def like(a: Bound, b: Bound, line: bool) -> Column:
    for x in (a, b):
        if not (x.type.textual or x.type is t.NULL):
            raise InvalidExpression(f"LIKE needs text, not {x.type}")
    if t.NULL in (a.type, b.type):
        return _null("boolean")
    if not line:
        return F.like(a.column, b.column, F.lit(NO_ESCAPE))
    # quoted runs between the wildcards; a literal \E in the pattern ends and renews the quotation
    body = F.replace(b.column, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    body = F.replace(F.replace(body, F.lit("%"), F.lit("\\E.*\\Q")), F.lit("_"), F.lit("\\E.\\Q"))
    return F.rlike(a.column, F.concat(F.lit("(?d)\\A\\Q"), body, F.lit("\\E\\z")))


def in_list(target: Bound, items: list[Bound]) -> Column:
    if not items:
        return F.when(target.column.isNull(), _null("boolean")).otherwise(F.lit(False))
    if target.type is t.NULL:
        return _null("boolean")
    return reduce(operator.or_, (compare("=", target, i) for i in items))


def bind(e: Expr, scope: Scope) -> Bound:
    if isinstance(e, Lit):
        return Bound(literal(e), e.type)
    if isinstance(e, Col):
        return _field(scope.find(e.name))
    if isinstance(e, ColIdx):
        if not 0 <= e.index < len(scope.fields):
            raise InvalidExpression(f"no column at {e.index}")
        return _field(scope.fields[e.index])
    if isinstance(e, Not):
        return Bound(~_truth(bind(e.child, scope), "NOT"), t.BOOL)
    if isinstance(e, IsNull):
        return Bound(bind(e.child, scope).column.isNull(), t.BOOL)
    if isinstance(e, IsNotNull):
        return Bound(bind(e.child, scope).column.isNotNull(), t.BOOL)
    if isinstance(e, InList):
        target = bind(e.child, scope)
        if isinstance(e.child, Lit) is False and e.items and all(isinstance(i, Lit) and i.value is not None and i.type == target.type for i in e.items) and target.type.kind != "Timestamp":
            return Bound(target.column.isin(*(i.value for i in e.items)), t.BOOL)  # one IN that reaches the scan
        return Bound(in_list(target, [bind(i, scope) for i in e.items]), t.BOOL)
    if isinstance(e, Binary):
        a, b = bind(e.left, scope), bind(e.right, scope)
        if e.op in COMPARE:
            return Bound(compare(e.op, a, b), t.BOOL)
        if e.op == "AND":
            return Bound(_truth(a, "AND") & _truth(b, "AND"), t.BOOL)
        if e.op == "OR":
            return Bound(_truth(a, "OR") | _truth(b, "OR"), t.BOOL)
        if e.op == "LIKE":
            return Bound(like(a, b, scope.line_like), t.BOOL)
        if e.op in (*ARITHMETIC, "/"):
            return arithmetic(e.op, a, b)
    raise InvalidExpression(f"unknown expression {e!r}")


def predicate(e: Expr, scope: Scope) -> Column:
    """A condition for a filter, which keeps what is true."""
    return _truth(bind(e, scope), "a condition")
