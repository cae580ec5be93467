"""Labelled messages (JSON lines), draft checks (JSON) and the document corpus (markdown)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("email_from", T.StringType()),
    T.StructField("email_subject", T.StringType()),
    T.StructField("email_body", T.StringType()),
    T.StructField("expected", T.StructType([
        T.StructField("categorie", T.StringType()),
        T.StructField("priorite", T.StringType()),
        T.StructField("verdict", T.StringType())])),
    T.StructField("notes", T.StringType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("success_criteria", T.StringType()),
])


def read_labelled(spark: SparkSession, labelled: str, adversarial: str | None = None
                  ) -> DataFrame:
    """Labelled messages, with the adversarial ones appended when asked for.

    Blank lines are skipped; fields a file lacks come out null. A line that is no message
    ends the job with its text: figures over fewer messages than the file holds would
    mislead. ``labelled_lines`` sorts such lines out instead.
    """
    rows, _ = labelled_lines(spark, labelled, adversarial, fail=True)
    return rows


def labelled_lines(spark: SparkSession, labelled: str, adversarial: str | None = None,
                   fail: bool = False) -> tuple[DataFrame, DataFrame]:
    """(messages, rejects): rejects (line, problem) are lines that are broken or lack an id."""
    lines = spark.read.text(labelled)
    if adversarial is not None:
        lines = lines.unionByName(spark.read.text(adversarial))
    shape = T.StructType([*LABELLED.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.where(F.trim("value") != "").select(
        "value", F.from_json("value", shape, {"columnNameOfCorruptRecord": "_corrupt"}).alias("m"))
    problem = F.when(F.col("m").isNull() | F.col("m._corrupt").isNotNull(), "broken").when(
        F.col("m.id").isNull(), "no_id")
    parsed = parsed.withColumn("problem", problem)
    if fail:
        text = F.concat(F.lit("labelled line without a message: "), F.col("value"))
        parsed = parsed.withColumn("problem", F.when(
            F.col("problem").isNotNull(), F.raise_error(text).cast("string")))
    rows = parsed.where(F.col("problem").isNull()).select(
        *[F.col(f"m.{f.name}") for f in LABELLED.fields])
    return rows, parsed.where(F.col("problem").isNotNull()).select(
        F.col("value").alias("line"), "problem")


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """Draft assertions from one JSON object keyed by case id; keys with '_' are comments."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", "map<string,string>"))
    parsed = whole.select(F.explode(F.coalesce(entries, F.array())).alias("e")).where(
        ~F.col("e.key").startswith("_"))
    schema = ("forbidden array<string>, required array<string>, must_be_empty boolean, "
              "why string")
    none = F.array().cast("array<string>")
    return parsed.select(
        F.col("e.key").alias("id"), F.from_json("e.value", schema).alias("c")).select(
        "id", F.coalesce("c.forbidden", none).alias("forbidden"),
        F.coalesce("c.required", none).alias("required"),
        F.coalesce("c.must_be_empty", F.lit(False)).alias("must_be_empty"),
        F.col("c.why").alias("why"))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text): one row per markdown file, source = file name without its ending."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(
        F.regexp_replace(name, r"\.md$", "").alias("source"), F.col("value").alias("text"))
