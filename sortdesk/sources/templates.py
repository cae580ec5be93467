"""Versioned prompt templates: <name>_v<major>.<minor>.txt"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_NAME = r"^([a-z_]+)_v(\d+)\.(\d+)\.txt$"


def template_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, content) of every file in a folder."""
    return spark.read.text(folder, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"),
        F.col("value").alias("content"))


def template_catalogue(files: DataFrame) -> DataFrame:
    """(name, maj, min, content) of the files whose name follows the convention."""
    name = F.col("file_name")
    return files.where(name.rlike(FILE_NAME)).select(
        F.regexp_extract(name, FILE_NAME, 1).alias("name"),
        F.regexp_extract(name, FILE_NAME, 2).cast("int").alias("maj"),
        F.regexp_extract(name, FILE_NAME, 3).cast("int").alias("min"),
        "content")


def latest_templates(catalogue: DataFrame, pins: DataFrame | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    """(chosen, missing): per name the pinned version, else the numerically greatest one.

    ``pins`` holds (name, version). Pins that name no known template or version are
    ``missing``; a caller that cannot go on without them checks that it is empty.
    """
    versioned = catalogue.withColumn(
        "version", F.concat_ws(".", F.col("maj").cast("string"), F.col("min").cast("string")))
    rank = F.struct("maj", "min")
    greatest = versioned.groupBy("name").agg(
        F.max_by("version", rank).alias("version"), F.max_by("content", rank).alias("content"))
    if pins is None:
        return greatest, greatest.select("name", "version").where(F.lit(False))
    pinned = versioned.join(pins, ["name", "version"]).select("name", "version", "content")
    chosen = greatest.join(pins, "name", "left_anti").unionByName(pinned)
    return chosen, pins.join(versioned, ["name", "version"], "left_anti")


AGENTS = ("classifier", "drafter", "judge")


def with_template_versions(df: DataFrame, chosen: DataFrame,
                           agents: tuple[str, ...] = AGENTS) -> DataFrame:
    """Results with the version of every agent's template as tpl_<name>, null without one.

    The versions become one row, whatever the size of the catalogue, and that row is joined.
    """
    versions = chosen.where(F.col("name").isin(*agents)).agg(*[
        F.max(F.when(F.col("name") == a, F.col("version"))).alias(f"tpl_{a}") for a in agents])
    return df.join(F.broadcast(versions))
