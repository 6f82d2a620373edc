"""Statements over streams.

A statement that keeps no order and no limit compiles to the same plan over a streaming DataFrame: filters and projections run in
append mode, groupings in complete or update mode. Others are refused, since a stream has no last row to sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import InvalidExpression
from ..plans.compile import compile
from ..statement import Statement


def compile_stream(stmt: Statement, df: DataFrame, like_mode: str = "text") -> DataFrame:
    if not df.isStreaming:
        raise InvalidExpression("not a streaming DataFrame")
    if stmt.order_by or stmt.limit is not None or stmt.offset:
        raise InvalidExpression("a stream has neither order nor limit")
    return compile(stmt, df, like_mode)
