"""Expressions as plain values; plans.bind turns them into Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

from . import types as t
from .types import DataType


class Expr:
    """Methods build larger expressions: col("a").gt(lit(1)).and_(col("b").is_null())."""

    def _with(self, op: str, other: object) -> Expr:
        return Binary(op, self, other if isinstance(other, Expr) else lit(other))

    def eq(self, o: object) -> Expr:
        return self._with("=", o)

    def ne(self, o: object) -> Expr:
        return self._with("<>", o)

    def lt(self, o: object) -> Expr:
        return self._with("<", o)

    def le(self, o: object) -> Expr:
        return self._with("<=", o)

    def gt(self, o: object) -> Expr:
        return self._with(">", o)

    def ge(self, o: object) -> Expr:
        return self._with(">=", o)

    def and_(self, o: object) -> Expr:
        return self._with("AND", o)

    def or_(self, o: object) -> Expr:
        return self._with("OR", o)

    def like(self, o: object) -> Expr:
        return self._with("LIKE", o)

    def add(self, o: object) -> Expr:
        return self._with("+", o)

    def sub(self, o: object) -> Expr:
        return self._with("-", o)

    def mul(self, o: object) -> Expr:
        return self._with("*", o)

    def div(self, o: object) -> Expr:
        return self._with("/", o)

    def not_(self) -> Expr:
        return Not(self)

    def is_null(self) -> Expr:
        return IsNull(self)

    def is_not_null(self) -> Expr:
        return IsNotNull(self)

    def in_(self, *items: object) -> Expr:
        return InList(self, tuple(i if isinstance(i, Expr) else lit(i) for i in items))


@dataclass(frozen=True)
class Lit(Expr):
    value: object
    type: DataType


@dataclass(frozen=True)
class Col(Expr):
    name: str


@dataclass(frozen=True)
class ColIdx(Expr):
    index: int


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    child: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    child: Expr


@dataclass(frozen=True)
class IsNotNull(Expr):
    child: Expr


@dataclass(frozen=True)
class InList(Expr):
    child: Expr
    items: tuple[Expr, ...]


def lit(value: object, type: DataType | None = None) -> Lit:
    """A literal; a type is needed for Enum and Custom only."""
    found = type or t.of_value(value)
    if value is not None:
        t.check(value, found)
    return Lit(value, found)


def col(name: str) -> Col:
    return Col(name)


def col_at(index: int) -> ColIdx:
    return ColIdx(index)


def renamed(e: Expr, old: str, new: str) -> Expr:
    """e with column `old` called `new`."""
    if isinstance(e, Col):
        return Col(new) if e.name.lower() == old.lower() else e
    if isinstance(e, Binary):
        return Binary(e.op, renamed(e.left, old, new), renamed(e.right, old, new))
    if isinstance(e, InList):
        return InList(renamed(e.child, old, new), tuple(renamed(i, old, new) for i in e.items))
    return type(e)(renamed(e.child, old, new)) if isinstance(e, (Not, IsNull, IsNotNull)) else e


def columns_in(e: Expr) -> set[str]:
    """Names, in lower case."""
    if isinstance(e, Col):
        return {e.name.lower()}
    kids = [getattr(e, k) for k in ("left", "right", "child") if hasattr(e, k)] + list(getattr(e, "items", ()))
    return set().union(*map(columns_in, kids))
