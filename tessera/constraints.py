"""Constraints as queries over the rows to be published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ExecutionError, MetadataError, evaluating
from .expr import Expr, columns_in
from .operators.relational import scope_of
from .plans.bind import bind, quoted
from .sources.catalog import Table


def checks(table: Table) -> list[Expr]:
    return [x for c in table.columns for x in c.checks] + [k.check for k in table.keys if k.kind == "check" and k.check is not None]


def validate_check(df: DataFrame, e: Expr) -> None:
    if bind(e, scope_of(df)).type.kind not in ("Bool", "Null"):
        raise MetadataError("a CHECK must be boolean")


def keys(table: Table) -> list[list[str]]:
    """Column lists that must be unique where none of them is null."""
    return [[c.name] for c in table.columns if c.keyed] + [k.columns for k in table.keys if k.kind in ("primary_key", "unique")]


def required(table: Table) -> list[str]:
    more = {n.lower() for k in table.keys if k.kind == "primary_key" for n in k.columns}
    return [c.name for c in table.columns if not c.nullable or c.name.lower() in more]


def check_rows(df: DataFrame, table: Table) -> None:
    """NOT NULL, enum variants and CHECK, in one pass; a CHECK fails on false only."""
    broken = {f"column {n} is null": quoted(n).isNull() for n in required(table)}
    broken |= {f"column {c.name} has no such variant": quoted(c.name).isNotNull() & ~quoted(c.name).isin(*c.type.variants) for c in table.columns if c.type.kind == "Enum"}
    for i, e in enumerate(checks(table)):
        validate_check(df, e)
        broken[f"check {i} on {', '.join(sorted(columns_in(e)))} fails"] = ~F.coalesce(bind(e, scope_of(df)).column.cast("boolean"), F.lit(True))
    if broken:
        with evaluating():
            row = df.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(f"b{i}") for i, c in enumerate(broken.values()))).first()
        for what, bad in zip(broken, row):
            if bad:
                raise ExecutionError(what)


def check_unique(new: DataFrame, old: DataFrame | None, table: Table, only: set[str] | None = None) -> None:
    """Within new, and against old; only: the columns that changed, others need no look."""
    for names in keys(table):
        if only is not None and not {n.lower() for n in names} & only:
            continue
        cols = [quoted(n) for n in names]
        own = new.select(*(c.alias(f"k{i}") for i, c in enumerate(cols))).dropna()
        with evaluating():
            twice = not own.groupBy(*own.columns).count().filter("count > 1").isEmpty()
            if not twice and old is not None:
                there = old.select(*(c.alias(f"k{i}") for i, c in enumerate(cols))).dropna()
                twice = not there.join(own, own.columns, "left_semi").isEmpty()  # the batch is the side that can be broadcast
        if twice:
            raise ExecutionError(f"{', '.join(names)} must be unique")
