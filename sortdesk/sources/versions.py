"""Tables whose valid files are named by a manifest, replaced in one step.

Data goes to folders of its own first. Then one manifest file names the folders of every table that
make up the next version; it appears with the rename that commits its single part file. A reader
takes the newest manifest, so it sees the old version or the new one, never both or a half, and a
run that ends in between leaves the former version as it was. Folders that no manifest names are
ignored. One writer at a time: two commits of one number are found out, and the later one fails.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "number long, table string, folder string, commit string"


def _manifests(spark: SparkSession, path: str) -> list:
    """The rows of the newest manifest: one for each folder."""
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{path}/manifests/*")
        newest = rows.agg(F.max("number")).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    found = rows.where(F.col("number") == newest).collect() if newest is not None else []
    first = min((r["commit"] for r in found), default=None)
    return [r for r in found if r["commit"] == first]


def folders(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """{table: its folders} of the newest version."""
    out: dict[str, list[str]] = {}
    for r in _manifests(spark, path):
        out.setdefault(r["table"], []).append(r["folder"])
    return out


def _commit(spark: SparkSession, path: str, tables: dict[str, list[str]], number: int) -> None:
    commit = uuid.uuid4().hex
    rows = [(number, table, folder, commit) for table, parts in tables.items() for folder in parts]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(f"{path}/manifests/{number:012}-{commit}")
    if _manifests(spark, path)[0]["commit"] != commit:
        raise RuntimeError(f"another writer committed version {number} of {path}")


def _next(spark: SparkSession, path: str) -> int:
    return max((r["number"] for r in _manifests(spark, path)), default=0) + 1


def _stored(df: DataFrame, path: str, table: str) -> str:
    folder = f"{path}/data/{table}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return folder


def read(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """The table as of the newest version, or None before the first."""
    parts = folders(spark, path).get(table)
    return spark.read.option("mergeSchema", True).parquet(*parts) if parts else None


def replace(path: str, tables: dict[str, DataFrame]) -> None:
    """A version that consists of these tables, all of them or none."""
    spark = next(iter(tables.values())).sparkSession
    number = _next(spark, path)
    _commit(spark, path, {name: [_stored(df, path, name)] for name, df in tables.items()}, number)


def append(path: str, table: str, rows: DataFrame) -> None:
    """A version with these rows more in one table."""
    spark = rows.sparkSession
    number, now = _next(spark, path), folders(spark, path)
    _commit(spark, path, now | {table: [*now.get(table, []), _stored(rows, path, table)]}, number)


def compact(spark: SparkSession, path: str, table: str) -> None:
    """A version with the table's rows in one folder, in files of the writer's own size."""
    number, now = _next(spark, path), folders(spark, path)
    if len(now.get(table, [])) > 1:
        merged = read(spark, path, table).hint("rebalance")
        _commit(spark, path, now | {table: [_stored(merged, path, table)]}, number)
