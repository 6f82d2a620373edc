"""Tessera: a relational query layer and table store that compile to Spark plans."""

from .engine import Engine, Result, configure
from .expr import col, col_at, lit
from .plans.compile import compile
from .statement import Aggregate, OrderBy, Statement, agg_max, agg_min, agg_sum, all_aggregates, asc, avg, count, desc

__all__ = ["Aggregate", "Engine", "OrderBy", "Result", "Statement", "agg_max", "agg_min", "agg_sum", "all_aggregates", "asc", "avg", "col", "col_at", "compile", "configure", "count", "desc", "lit"]
