"""Ordered, per-key carrying of values without one task per key.

A window over a key sorts the whole key in one task. Here every key is cut into blocks of
the order column, the last value of each block is aggregated (map-side partial
aggregation), the carry between blocks runs over those aggregates only, and the rows of a
block are finished on their own. A key that holds a third of all rows is therefore spread
over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, keys: list[str], order: list[str], block: Column,
                  value: Column, out: str, include_current: bool = False,
                  salt: Column | None = None) -> DataFrame:
    """Add the last non-null ``value`` before each row (at it too with include_current).

    ``block`` must grow with ``order`` within a key. ``salt`` splits the rows of one block
    further; rows that carry a value must then already be present in every salt. A row with
    a null key, or without a first order value, has no place in a sequence: it carries
    nothing on and comes out with a null.
    """
    whole = df.withColumn("__v", value).withColumn("__b", block)
    whole = whole.withColumn("__s", salt if salt is not None else F.lit(0))
    placed = F.col("__b").isNotNull() & F.col(order[0]).isNotNull()
    for key in keys:
        placed = placed & F.col(key).isNotNull()
    work, loose = whole.where(placed), whole.where(~placed)
    at = F.when(F.col("__v").isNotNull(), F.struct(*order))
    # One row per block, with its last value or null: the carry runs over these only.
    blocks = (
        work.groupBy(*keys, "__b").agg(F.max_by("__v", at).alias("__end"))
        .withColumn("__carry", F.last("__end", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy("__b")
            .rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, "__b", "__carry")
    )
    last_row = Window.currentRow if include_current else -1
    inside = F.last("__v", ignorenulls=True).over(
        Window.partitionBy(*keys, "__b", "__s").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, last_row))
    carried = (
        work.withColumn("__in", inside)
        .join(blocks, [*keys, "__b"])
        .withColumn(out, F.coalesce("__in", "__carry"))
        .drop("__in", "__carry"))
    kind = carried.schema[out].dataType
    return carried.unionByName(loose.withColumn(out, F.lit(None).cast(kind))).drop(
        "__v", "__b", "__s")


def block_of(order: str, width: int) -> Column:
    """Block number of an integer order column."""
    return F.floor(F.col(order) / F.lit(width)).cast("long")
