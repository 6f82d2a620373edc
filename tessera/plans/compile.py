"""A statement over a DataFrame: filter, aggregate, sort, project, limit, always in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.relational import apply_aggregate, apply_filter, apply_limit, apply_project, apply_sort
from ..statement import Statement


def compile(stmt: Statement, df: DataFrame, like_mode: str = "text") -> DataFrame:
    """like_mode "line": the dot of LIKE's wildcards does not cross line ends."""
    line = like_mode == "line"
    if stmt.where is not None:
        df = apply_filter(df, stmt.where, line)
    if stmt.group_by or stmt.aggregates:
        df = apply_aggregate(df, stmt.group_by, stmt.aggregates)
    if stmt.order_by:
        df = apply_sort(df, stmt.order_by, line)
    df = apply_project(df, stmt.projection, line)
    return apply_limit(df, stmt.limit, stmt.offset)
