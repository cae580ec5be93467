"""Writing run metrics and evaluation results."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import masking as M
from ..functions.text import text_or_empty
from ..operators.guardrail import cost_usd
from . import versions


def schema_version(columns=V.RUN_METRICS_COLUMNS) -> str:
    """Fingerprint of the column list: another list writes to another folder."""
    text = ",".join(f"{name}:{kind}" for name, kind in columns)
    return hashlib.md5(text.encode()).hexdigest()[:12]


def run_metrics(results: DataFrame, columns=V.RUN_METRICS_COLUMNS) -> DataFrame:
    """Decided messages as run-metrics rows: the listed columns in order, others dropped.

    Columns a result lacks come out null; confidence and score are rounded to three
    digits, the cost to six.
    """
    df = results
    have = set(df.columns)
    derived = {}
    if "timestamp_utc" not in have:
        derived["timestamp_utc"] = F.date_trunc("second", F.current_timestamp())
    if "pii_entities" in have:
        derived["pii_entities"] = M.entities_text("pii_entities")
    if {"tokens_in", "tokens_out"} <= have:
        derived["cost_usd"] = F.round(cost_usd("tokens_in", "tokens_out"), 6)
    for name in ("job_id", "message_id", "judge_verdict"):
        if name in have:
            derived[name] = text_or_empty(name)
    if "confiance" in have:
        derived["confiance"] = F.round("confiance", 3)
    for criterion in V.JUDGE_CRITERIA:
        if criterion in have:
            derived[f"judge_{criterion}"] = F.col(criterion)
    if "critic_score" in have:
        derived["judge_score"] = F.round("critic_score", 3)
    if "human_decision" not in have:
        derived["human_decision"] = F.lit("")
    if "errors" in have and dict(df.dtypes)["errors"].startswith("array"):
        derived["errors"] = F.array_join("errors", " | ")
    df = df.withColumns(derived)
    have = set(df.columns)
    return df.select(*[
        (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
        for name, kind in columns])


def _dated(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("run_date", F.to_date("timestamp_utc"))


def write_run_metrics(results: DataFrame, path: str, columns=V.RUN_METRICS_COLUMNS) -> None:
    """Append one row per message, by date, below the folder of the schema version."""
    _dated(run_metrics(results, columns)).write.mode("append").partitionBy("run_date").parquet(
        f"{path}/schema_version={schema_version(columns)}")


def read_run_metrics(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/schema_version={version or schema_version()}")


def log_run_metrics(results: DataFrame, path: str) -> None:
    """Append one row per message to a log of versions, which ``versions.compact`` can merge."""
    versions.append(path, f"metrics-{schema_version()}", _dated(run_metrics(results)))


def compact_run_metrics(spark: SparkSession, path: str) -> None:
    versions.compact(spark, path, f"metrics-{schema_version()}")


def logged_run_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    return versions.read(spark, path, f"metrics-{schema_version()}")


def write_eval(detail: DataFrame, summary: DataFrame, path: str) -> None:
    """Detail as CSV with a header and doubled quotes, summary as JSON."""
    flat = [F.array_join(c, " | ").alias(c) if kind.startswith("array") else F.col(c)
            for c, kind in detail.dtypes]
    detail.select(*flat).write.mode("overwrite").options(
        header=True, escape='"').csv(f"{path}/detail")
    summary.write.mode("overwrite").json(f"{path}/summary")
