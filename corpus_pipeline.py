"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents.

Defined results. Null, empty and very long texts, repeated rows and empty tables pass through every
stage; what each does with them is said in the operators. Documents without an id are kept, as
nothing can be the same document. Rows that share an id are one document and share its fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortdesk.llm import decontamination, near_duplicates, pieces, pseudonyms, toxicity
from sortdesk.llm.queries import PIECE_MODEL, PSEUDONYM_KEY
from sortdesk.llm.store import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; it is fitted on their labelled rows."""
    docs = docs.select(*COLUMNS)
    return toxicity.toxic_documents(docs, table(spark, sf_dir, "labels")).where(
        "not toxicity.rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 of five-word shingles, the document of least id stays."""
    docs = docs.select(*COLUMNS)
    found = near_duplicates.near_duplicates(docs, shingle=5, percent=80)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages leave the texts; texts that are little else go."""
    docs = docs.select(*COLUMNS)
    clean = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers and dates become pseudonyms of the same format."""
    hidden = pseudonyms.pseudonymise(docs.select(*COLUMNS), PSEUDONYM_KEY).select(*COLUMNS)
    return hidden.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with begin and end, and digests of ids and decoded text."""
    encoded = pieces.encode_pieces(docs.select("doc_id", "lang", "source", "text"), PIECE_MODEL)
    return encoded.select("doc_id", "lang", "source", "pieces.n_tokens", "pieces.ids",
                          "pieces.ids_sha256", "pieces.decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates),
          ("decontamination", remove_benchmarks), ("personal data", hide_personal_data),
          ("pieces", to_pieces)]

#: The trained first stage cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
