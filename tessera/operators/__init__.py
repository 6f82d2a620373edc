"""The relational operators, each from a DataFrame to a DataFrame."""

from .relational import apply_aggregate, apply_filter, apply_limit, apply_project, apply_sort, scan

__all__ = ["apply_aggregate", "apply_filter", "apply_limit", "apply_project", "apply_sort", "scan"]
