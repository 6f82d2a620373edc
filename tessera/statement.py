"""A SELECT over one table: WHERE, GROUP BY with aggregates, ORDER BY, projection, OFFSET and LIMIT, in that order."""

from __future__ import annotations

from dataclasses import dataclass

from .expr import Col, Expr

FUNCTIONS = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Aggregate:
    """fn over a column; count without one counts rows. The output is called {fn}_{place in the list}."""

    fn: str
    column: str | None = None


@dataclass(frozen=True)
class OrderBy:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Statement:
    """No projection means all columns. A projected column keeps its name as spelled here; other expressions are called col_{place}."""

    where: Expr | None = None
    group_by: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    order_by: tuple[OrderBy, ...] = ()
    projection: tuple[Expr, ...] = ()
    limit: int | None = None
    offset: int = 0


def count(column: str | None = None) -> Aggregate:
    return Aggregate("count", column)


def agg_sum(column: str) -> Aggregate:
    return Aggregate("sum", column)


def avg(column: str) -> Aggregate:
    return Aggregate("avg", column)


def agg_min(column: str) -> Aggregate:
    return Aggregate("min", column)


def agg_max(column: str) -> Aggregate:
    return Aggregate("max", column)


def all_aggregates(counted: str | None = None, summed: str | None = None, averaged: str | None = None, least: str | None = None, most: str | None = None) -> tuple[Aggregate, ...]:
    """A count always, then sum, avg, min and max of the columns given."""
    rest = zip(FUNCTIONS[1:], (summed, averaged, least, most))
    return (Aggregate("count", counted), *(Aggregate(f, c) for f, c in rest if c is not None))


def asc(e: Expr | str) -> OrderBy:
    return OrderBy(Col(e) if isinstance(e, str) else e)


def desc(e: Expr | str) -> OrderBy:
    return OrderBy(Col(e) if isinstance(e, str) else e, True)
