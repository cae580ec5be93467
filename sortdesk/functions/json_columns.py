"""Maps and arrays kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def to_json_col(c: Column | str) -> Column:
    """JSON text of a map, array or struct; '' for null."""
    return F.coalesce(F.to_json(col(c)), F.lit(""))


def from_json_col(c: Column | str, schema: str, default: Column) -> Column:
    """Value of a JSON text; the default for null, empty or damaged text."""
    text = F.nullif(col(c), F.lit(""))
    return F.coalesce(F.from_json(text, schema), default)
