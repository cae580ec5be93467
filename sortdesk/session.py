"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def builder(app: str = "sortdesk") -> SparkSession.Builder:
    """Session defaults: UTC, adaptive execution, skew handling."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, named by the cluster in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="sortdesk-checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared checkpoint folder and read it again: computed once, kept
    when executors are lost, and joined later with an exchange that can be split."""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir() or _folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FOLDERS: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = checkpoint_dir(spark)
    return _FOLDERS[app]
