"""Filter, aggregate, sort, project and limit, as Spark plans: nothing here runs, Catalyst prunes, pushes down and picks the physical plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as t
from ..errors import ColumnAlreadyExists, InvalidExpression
from ..expr import Col, Expr
from ..plans.bind import Scope, bind, predicate, quoted
from ..statement import FUNCTIONS, Aggregate, OrderBy

#: Order of insertion, in stored tables only: the number of the insertion and the row's in it. Breaks ties of sorts, never shown.
RID, RID_TYPE = "_rid", T.StructType().add("seq", "long").add("row", "long")


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def scope_of(df: DataFrame, line_like: bool = False) -> Scope:
    return Scope.of(df, (RID,), line_like)


def apply_filter(df: DataFrame, condition: Expr, line_like: bool = False) -> DataFrame:
    return df.filter(predicate(condition, scope_of(df, line_like)))


def apply_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    """Keys, then {fn}_{place}. Without aggregates: the distinct keys. Without keys: one row, for empty input as well."""
    scope = scope_of(df)
    found = [scope.find(k) for k in keys]
    names = [k for k, *_ in found]
    if len({n.lower() for n in names}) < len(names):
        raise ColumnAlreadyExists(next(n for i, n in enumerate(names) if n in names[:i]))
    outs = []
    for i, a in enumerate(aggregates):
        if a.fn not in FUNCTIONS or a.column is None and a.fn != "count":
            raise InvalidExpression(f"no aggregate {a.fn}({a.column or '*'})")
        if a.column is None:
            outs.append(F.count(F.lit(1)).alias(f"count_{i}"))
            continue
        x = bind(Col(a.column), scope)
        if a.fn in ("sum", "avg") and not x.type.numeric or x.type is t.OTHER and a.fn != "count":
            raise InvalidExpression(f"{a.fn} of {x.type}")
        meta = {t.METADATA: t.to_json(x.type)} if a.fn in ("min", "max") and x.type.kind in ("Enum", "Custom") else None
        out = getattr(F, a.fn)(x.column)
        outs.append(out.alias(f"{a.fn}_{i}", metadata=meta) if meta else out.alias(f"{a.fn}_{i}"))
    if not outs:
        return df.select(*map(quoted, names)).distinct()
    return df.groupBy(*map(quoted, names)).agg(*outs)


def apply_sort(df: DataFrame, specs: Sequence[OrderBy], line_like: bool = False) -> DataFrame:
    """Nulls are the smallest values. Ties keep the order of insertion where the table has it."""
    scope = scope_of(df, line_like)
    order = []
    for s in specs:
        c = bind(s.expr, scope).column
        order.append(c.desc_nulls_last() if s.descending else c.asc_nulls_first())
    return df.orderBy(*order, *([RID] if RID in df.columns else []))


def apply_project(df: DataFrame, exprs: Sequence[Expr], line_like: bool = False) -> DataFrame:
    """No expressions: all columns (but RID)."""
    scope = scope_of(df, line_like)
    if not exprs:
        return df.drop(RID)
    out, seen = [], set()
    for i, e in enumerate(exprs):
        x, name = bind(e, scope), e.name if isinstance(e, Col) else f"col_{i}"
        if name.lower() in seen:
            raise ColumnAlreadyExists(name)
        seen.add(name.lower())
        column = x.column if x.type is not t.NULL else x.column.cast("bigint")
        named = x.type.kind in ("Enum", "Custom")
        out.append(column.alias(name, metadata={t.METADATA: t.to_json(x.type)}) if named else column.alias(name))
    return df.select(*out)


def apply_limit(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    if offset < 0 or limit is not None and limit < 0:
        raise InvalidExpression("limit and offset are not negative")
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)
