"""Shorthand shared by the query modules."""

from __future__ import annotations

from cliploom.functions.rounding import rounded, rounded_sql
from cliploom.registry import query
from cliploom.sources import views
from cliploom.sources.tables import table

__all__ = ["query", "rounded", "rounded_sql", "table", "views", "with_views"]


def with_views(*names: str, more: str = "", recursive: bool = False) -> str:
    """``WITH`` clause defining the named capture views, plus extra CTE text."""
    parts = [getattr(views, f"{n.upper()}_SQL") for n in names]
    if more:
        parts.append(more)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"
