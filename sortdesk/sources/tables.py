"""Reading tables so that the work is spread from the first stage on."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL_BYTES = 256 << 20


def spread_small(df: DataFrame, key: str, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Repartition a small table that comes in fewer files than there are cores.

    A row group is read by one task, so a table of one small file keeps all its pattern
    work on one core. Larger tables, and tables of many files, already have enough
    splits and are left alone: their texts are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size <= small_bytes else df
