"""Streams in several batches keep every row of the table."""

from pyspark.sql import functions as F

from sortdesk.operators.admission import dedupe_ttl
from sortdesk.plans import catalog_streaming
from sortdesk.plans.catalog import queries
from sortdesk.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_rows_without_time_stay_in_the_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events = events.withColumn("ts", F.when(F.col("event_id") % 20 != 0, F.col("ts")))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert events.where("ts is null").count() > 0
    got, wanted = (queries()[name](spark, str(tmp_path)).collect()
                   for name in ("stream_dedupe_ttl", "dedupe_ttl"))
    key = lambda rows: sorted(map(repr, rows))
    assert len(got) == events.count() and key(got) == key(wanted)


def test_parts_hold_every_row_once_in_order(spark):
    rows = spark.range(100).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("o"), "id")
    parts = [[r.o for r in p.collect()] for p in catalog_streaming._parts(rows, "o")]
    assert len(parts) == catalog_streaming.BATCHES and sum(map(len, parts)) == 100
    assert parts[0].count(None) == 10 and None not in sum(parts[1:], [])
    held = [[o for o in p if o is not None] for p in parts]
    assert all(max(a) < min(b) for a, b in zip(held, held[1:]))
    assert sum(p.count() for p in catalog_streaming._parts(rows.limit(0), "o")) == 0


def _stream_in_parts(spark, rows, folder, parts, job):
    rows.limit(0).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    for i in range(parts):
        rows.where(f"event_id % 1000 div 100 = {i}").write.mode("append").parquet(f"{folder}/in")
        job(stream).start().awaitTermination()


def _answers(df):
    return sorted(map(repr, df.select("event_id", "request_key", "anchor_id", "duplicate").collect()))


def test_dedupe_in_state_over_restarts(spark, tmp_path):
    """Repeats across batches, anchors that have expired, rows without key or time."""
    rows = spark.range(300).select(
        F.col("id").alias("event_id"),
        F.expr("if(id % 50 = 0, null, concat('k', id * 7 % 13))").alias("request_key"),
        F.expr("if(id % 70 = 0, null, timestamp_seconds(1700000000 + id * 97)::timestamp_ntz)").alias("ts"),
        F.lit("x").alias("_more"))
    _stream_in_parts(spark, rows, str(tmp_path), 3, lambda s: jobs.dedupe_state_to_files(
        s, f"{tmp_path}/out", f"{tmp_path}/state", ttl_s=1500))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.columns == [*rows.columns, "anchor_id", "duplicate"]
    assert _answers(got) == _answers(dedupe_ttl(rows, ttl_s=1500))
    assert got.where("duplicate").count() > 50


def test_rows_of_one_event_id_keep_their_own_anchors(spark, tmp_path):
    """Two keys under one event id in one batch, and a null event id inside a life."""
    at = lambda s: f"timestamp_seconds(1700000000 + {s})::timestamp_ntz"
    first = spark.sql(f"select 1L event_id, 'a' request_key, {at(0)} ts union all select 2L, 'b', {at(1)}")
    second = spark.sql(f"""select 7L event_id, 'a' request_key, {at(5)} ts union all
        select 7L, 'b', {at(6)} union all select null, 'a', {at(7)} union all select 8L, 'c', {at(8)}""")
    for i, batch in enumerate((first, second)):
        jobs.dedupe_batch(batch, i, str(tmp_path), ttl_s=100)
    got = spark.read.parquet(f"{tmp_path}/results").where("batch_id = 1").collect()
    assert sorted((r.event_id or 0, r.request_key, r.anchor_id, r.duplicate) for r in got) == [
        (0, "a", 1, True), (7, "a", 1, True), (7, "b", 2, True), (8, "c", 8, False)]


def test_keys_share_the_values_of_the_state_store(spark, tmp_path):
    """Many keys share the values of the store; anchors are forgotten when their lives are over."""
    def rows(start, n, at):
        return spark.range(start, start + n).select(
            F.col("id").alias("event_id"), F.expr("concat('k', id % 6000)").alias("request_key"),
            F.expr(f"timestamp_seconds({at} + id % 6000 % 7)::timestamp_ntz").alias("ts"))
    parts = [rows(0, 12000, 1700000000), rows(12000, 12000, 1700000050), rows(24000, 3, 1700009000),
             rows(30000, 3, 1700020000)]
    parts[0].limit(0).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(parts[0].schema).parquet(f"{tmp_path}/in")
    kept = []
    for part in parts:
        part.write.mode("append").parquet(f"{tmp_path}/in")
        query = jobs.dedupe_state_to_files(
            stream, f"{tmp_path}/out", f"{tmp_path}/state", ttl_s=100).start()
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    # a value, and a timer with its entry in the order of times, for each bucket
    assert 0 < kept[1] <= 3 * jobs.STATE_BUCKETS < 6000 and kept[-1] <= 9
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = spark.read.parquet(f"{tmp_path}/out")
    assert _answers(got) == _answers(dedupe_ttl(everything, ttl_s=100))
    assert got.where("duplicate").count() == 18000


def test_messages_of_few_files_are_dealt_out_before_the_patterns(spark, tmp_path, monkeypatch):
    spark.range(400).selectExpr(
        "id as doc_id", "concat('Bonjour, urgent ', id) as text", "'fr' as lang", "'mail' as source",
        "20L as n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plain, tasks = jobs.enqueue_batch, []

    def enqueue_batch(batch, *args):
        tasks.append(batch.rdd.getNumPartitions())
        plain(batch, *args)
    monkeypatch.setattr(jobs, "enqueue_batch", enqueue_batch)
    got, wanted = (queries()[name](spark, str(tmp_path)).collect()
                   for name in ("stream_enqueued_cases", "enqueued_cases"))
    assert len(tasks) == catalog_streaming.BATCHES
    assert min(tasks) >= spark.sparkContext.defaultParallelism
    assert len(got) > 0 and sorted(map(repr, got)) == sorted(map(repr, wanted))
