"""Where rows come from: arithmetic ranges, tables, in-memory sequences and user-defined partitioned sources."""

from millrace.sources.ranges import Range
from millrace.sources.tables import empty_like, one_row, table

__all__ = ["Range", "empty_like", "one_row", "table"]
