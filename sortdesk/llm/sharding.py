"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters the records uniformly into buckets that fit in memory, by a seeded hash of
content and scan position, so that equal rows spread as well. Pass two shuffles each bucket:
Spark's shuffle() draws a Fisher-Yates permutation of the bucket's places, and each record moves
to the place that its rank in the bucket is sent to. Buckets follow each other, and the global
place deals records to shards in turn: shard = place mod shards, slot = place div shards. So any
two shards differ by one row at most and slots have no gaps. Records move through one exchange.

The records are written once with their scatter hash, and both passes read that table, so they
agree on the buckets whatever becomes of an executor. The permutations are drawn bucket by bucket
in a fixed number of partitions and written before use, so a task that runs again meets the same ones.

Defined results. Null ids and texts are content like any other; an empty text counts one byte.
Repeated rows are records of their own. An empty table gives no rows. All columns are kept; the
added columns get underscores while the input has columns of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import free_name, written

BUCKET_BYTES = 16 << 20
#: Partitions that draw permutations, at most; fixed, since the draws depend on it.
DRAWING = 256


def text_bytes(text_col: str):
    """UTF-8 bytes of the text (null: none), and one."""
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1


def shuffled_shards(docs: DataFrame, shards: int = 16, seed: int = 17, text_col: str = "text",
                    id_col: str = "doc_id", bucket_bytes: int = BUCKET_BYTES,
                    shard: str = "shard", slot: str = "slot") -> DataFrame:
    """docs with the columns shard (0 to shards - 1) and slot (0, 1, ... within the shard)."""
    total = docs.agg(F.sum(text_bytes(text_col))).first()[0] or 0
    buckets = 1 + total // bucket_bytes
    scatter, bucket, places, start, rank = (
        free_name(docs, n) for n in ("_scatter", "_bucket", "_places", "_start", "_rank"))
    shard, slot = free_name(docs, shard), free_name(docs, slot)
    rows = docs.withColumn(scatter, F.xxhash64(
        F.lit(seed), id_col, text_col, F.monotonically_increasing_id()))
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), scatter), F.lit(buckets)))
    rows = written(rows, "scattered")

    sizes = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.select(
        bucket, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start)), "starts")
    dealt = starts.repartition(min(int(buckets), DRAWING), bucket).sortWithinPartitions(bucket)
    moves = written(dealt.select(
        bucket, start,
        F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), seed).alias(places)),
        "permutations")

    ranked = rows.withColumn(
        rank, F.row_number().over(Window.partitionBy(bucket).orderBy(scatter)))
    placed = ranked.join(moves, bucket)
    place = F.col(start) + F.element_at(places, F.col(rank))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns],
                         F.pmod(place, F.lit(shards)).cast("int").alias(shard),
                         F.floor(place / shards).cast("long").alias(slot))


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 16,
                 shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard; files of a shard follow each other in slot order."""
    shards = sharded.agg(F.max(shard)).first()[0]
    if shards is None:
        sharded.drop(shard).write.parquet(path)
        return
    (sharded.repartitionByRange((shards + 1) * files_per_shard, shard, slot)
     .sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path))
