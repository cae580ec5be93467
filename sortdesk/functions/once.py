"""Columns that are computed exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns so that later filters reuse them instead of repeating them.

    Catalyst moves a filter below a projection by copying the projected expressions into
    it; with a chain of text patterns that copy grows with every step. It does not move a
    filter on generated columns below their generator, so the columns come out of a
    generator that yields one row per row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
