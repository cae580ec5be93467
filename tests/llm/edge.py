"""Small tables with the awkward cases that every operator must stand."""

from pyspark.sql import functions as F

LONG_WORD = "x" * 70_000
LONG_TEXT = " ".join(f"w{i % 977} the of" for i in range(20_000))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank at dawn today ok"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank at dawn today ok"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank at dawn today ok"),
    (3, None), (4, ""), (5, " \n\t "), (6, "single"), (None, "no id here"), (None, None),
    (7, LONG_WORD), (8, LONG_TEXT), (9, "card 4785380592391139 a.b@mail.example.com 10.0.0.1"),
    (10, "été naïve ß 漢字 😀\u0000 end"), (11, "Released under the MIT License.\nmore"),
]


def documents(spark, rows=None, extra=True):
    """(doc_id, text, lang, source, n_chars), and with extra columns named like inner ones."""
    df = spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"),
                         "n_chars": F.length("text").cast("long")})
    if extra:
        for name in ("id", "sub", "h", "n", "label", "band", "shard", "slot", "pieces", "node",
                     "_bucket", "_found", "pseudonyms", "toxicity", "contamination", "spans"):
            df = df.withColumn(name, F.lit(name))
    return df


def empty(spark):
    return documents(spark, [])
