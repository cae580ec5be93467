"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets one folder for its lifetime."""
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = spark.sparkContext.getCheckpointDir() or checkpoint_dir(spark)
    return _LOCAL[app]


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    The table survives lost executors, is compressed, and later joins on it get an exchange
    of their own, which adaptive execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Let the session hand `rows` rows at a time to Python: texts may be long, and a batch is
    held by the JVM and by the worker at once. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def as_long(column: str):
    return F.col(column).cast("long")
