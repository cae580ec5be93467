"""The model-free classifier on documents it has not seen."""

from pyspark.sql import functions as F

from sortdesk.operators import model_io as D

SF = "/root/testdata/sf0.1"


def measured(labelled):
    """(rows, accuracy, share of the most frequent label, least probability) on a held-out quarter."""
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    scored = D.score_classifier(D.train_classifier(labelled.where(~held)), labelled.where(held))
    n, right, low = scored.agg(F.count("*"), F.avg((F.col("categorie") == F.col("label")).cast("int")),
                               F.min("confiance")).first()
    most = labelled.where(held).groupBy("label").count().agg(F.max("count")).first()[0] / n
    return n, right, most, low


def test_baseline_on_held_out_rows(spark):
    """Languages are in the words; the quality of these documents is hardly, so there the baseline
    only has to be no worse than the most frequent label."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0")
    n, right, most, low = measured(docs.select("doc_id", "text", F.col("lang").alias("label")).repartition(8))
    assert n > 500 and right > 0.9 > most and low > 0.25
    quality = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select(
        "doc_id", "text", F.col("quality").cast("string").alias("label")).repartition(8)
    n, right, most, low = measured(quality)
    assert n > 300 and right >= most - 0.01 and low >= 0.5
