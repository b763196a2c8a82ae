"""Intermediate tables in the folder that all executors share, and sizes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.sources.shared import materialized as written

__all__ = ["text_size", "written"]


def text_size(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column over all rows; plans take their number of groups from it."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)
