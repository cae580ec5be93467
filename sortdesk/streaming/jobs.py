"""The triage jobs on streams of messages.

Masking, rules and decision are row-wise, so a stream runs the very functions a table
does. Jobs with memory across batches keep it in append logs, by day or by key hash first and by
batch number second: a batch reads the folders that its own rows can touch, and a replayed
batch overwrites its own folders and never reads them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import fixed_values as V
from ..operators.admission import _micros, dedupe_ttl
from ..operators.cases import enqueue, idempotency_key
from ..operators.guardrail import cost_usd
from ..operators.policy import Policy
from ..plans.triage import triage
from ..sources.sinks import _dated, run_metrics, schema_version


def _available(writer: DataStreamWriter, checkpoint: str) -> DataStreamWriter:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _log_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Rows of an append log written by earlier batches, or None before the first one.

    Only a missing folder, or one without any file yet, counts as no log: a log that is
    there and cannot be read ends the job.
    """
    try:
        log = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return log.where(F.col("batch_id") < batch_id)


def _append_batch(rows: DataFrame, path: str, by: str, batch_id: int) -> None:
    """Write a batch into folders by=.../batch_id=..., leaving all other folders alone. Folders of
    many rows are written by several tasks, small ones by one."""
    (rows.withColumn("batch_id", F.lit(batch_id)).hint("rebalance", by).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(by, "batch_id").parquet(path))


# --- triage and metrics --------------------------------------------------------------------
def triage_to_files(messages: DataFrame, path: str, checkpoint: str, columns: list[str],
                    policy: Policy | None = None, spread: int | None = None) -> DataStreamWriter:
    """Decide a stream of messages with class, draft and verdict columns; append results.

    A batch of few files is read by as few tasks; `spread` deals its rows out to so many before the
    patterns run over them."""
    messages = messages.repartition(spread) if spread else messages
    results = triage(messages, policy).select(*columns)
    return _available(results.writeStream.format("parquet").option("path", path), checkpoint)


def metrics_to_files(results: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append run metrics by date."""
    rows = _dated(run_metrics(results))
    writer = rows.writeStream.format("parquet").partitionBy("run_date").option(
        "path", f"{path}/schema_version={schema_version()}")
    return _available(writer, checkpoint)


def metrics_by_hour(calls: DataFrame, ts: str = "ts", late: str = "10 minutes",
                    width: str = "1 hour") -> DataFrame:
    """Actions, tokens, cost and escalation rate per tumbling window.

    On a stream, rows later than ``late`` are dropped and a window comes out when the
    watermark has passed it; on a table every window comes out, with all its rows.
    """
    timed = calls.withColumn("__ts", F.col(ts).cast("timestamp"))
    if calls.isStreaming:
        timed = timed.withWatermark("__ts", late)
    return (
        timed.groupBy(F.window("__ts", width))
        .agg(F.count(F.lit(1)).alias("n"),
             F.count_if(F.col("action") == "AUTO").alias("n_auto"),
             F.count_if(F.col("action").isin("HITL", "MANUAL")).alias("n_escalated"),
             F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
        .select(F.col("window.start").alias("window_start"), "n", "n_auto", "n_escalated",
                "tokens_in", "tokens_out",
                F.round(cost_usd("tokens_in", "tokens_out"), 6).alias("cost_usd"),
                F.round(F.col("n_escalated") / F.col("n"), 6).alias("escalation_rate")))


_DAY = 86_400_000_000   # microseconds


# --- dedupe --------------------------------------------------------------------------------
def dedupe_batch(batch: DataFrame, batch_id: int, path: str, key: str = "request_key",
                 ts: str = "ts", order: str = "event_id", ttl_s: int = V.DEDUPE_TTL_S) -> None:
    """Mark repeats of one micro-batch against the anchors of earlier ones.

    Anchors are stored by day with their TTL-wide time bucket; only those that can still
    cover a row of this batch are read. A row inside the life of an earlier anchor is its duplicate, the
    others are settled among themselves. A row that arrives out of time order is judged
    by the anchors known at that moment.
    """
    spark, ttl = batch.sparkSession, ttl_s * 1_000_000
    batch = batch.persist()
    try:
        rows = batch.withColumn("__t", _micros(ts)).withColumn(
            "__b", F.floor(F.col("__t") / ttl).cast("long"))
        anchors = _log_before(spark, f"{path}/anchors", batch_id)
        span = rows.agg(F.min("__b"), F.max("__b")).first()
        if anchors is not None and span[0] is not None:
            days = [b * ttl // _DAY for b in (span[0] - 1, span[1] + 1)]
            near = anchors.where(F.col("day").between(*days)).where(
                F.col("bucket").between(span[0] - 1, span[1]))
            mark = F.struct("t", "id")
            # Out-of-order rows may leave two anchors in one bucket: the latest one that
            # is not after the row counts, so every anchor reaches its own bucket and the
            # next as one row, and the greatest suitable one is kept.
            reach = near.select(
                F.col("k").alias("__k"), mark.alias("__anchor"),
                F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("__rb"))
            covers = (
                (rows[key] == reach["__k"]) & (rows["__b"] == reach["__rb"])
                & (reach["__anchor"]["t"] <= rows["__t"])
                & (rows["__t"] - reach["__anchor"]["t"] <= ttl))
            # by key as well: rows of one event id may have several, and a null id has an anchor too
            found = rows.join(reach, covers).groupBy(rows[key].alias("__key"), F.col("__t")).agg(
                F.max("__anchor").alias("__anchor"))
            placed = batch.withColumn("__at", _micros(ts))
            own = (placed[key] == found["__key"]) & (placed["__at"] == found["__t"])
            repeats = placed.join(found, own).select(
                *batch.columns, F.col("__anchor")["id"].alias("anchor_id"),
                F.lit(True).alias("duplicate"))
            fresh = placed.join(found, own, "left_anti").select(*batch.columns)
            done = repeats.unionByName(
                dedupe_ttl(fresh, key, ts, order, ttl_s).select(*repeats.columns))
        else:
            done = dedupe_ttl(batch, key, ts, order, ttl_s)
        done.write.mode("overwrite").parquet(f"{path}/results/batch_id={batch_id}")
        # Read back what was written: the log, not a second run of the fold.
        written = spark.read.parquet(f"{path}/results/batch_id={batch_id}")
        kept = F.nullif(F.col(key).cast("string"), F.lit("")).isNotNull() & F.col(ts).isNotNull()
        new = written.where(~F.col("duplicate") & kept).select(
            F.col(key).alias("k"), _micros(ts).alias("t"), F.col(order).alias("id"))
        new = new.withColumns({"bucket": F.floor(F.col("t") / ttl).cast("long"),
                               "day": F.floor(F.col("t") / _DAY).cast("long")})
        _append_batch(new, f"{path}/anchors", "day", batch_id)
    finally:
        batch.unpersist()


def dedupe_to_files(requests: DataFrame, path: str, checkpoint: str, **options
                    ) -> DataStreamWriter:
    """Stream of requests -> results with anchor_id and duplicate, by batch."""
    return _available(requests.writeStream.foreachBatch(
        lambda batch, batch_id: dedupe_batch(batch, batch_id, path, **options)), checkpoint)


#: Keys share so many values of the state store: a call into Python costs the same for one key as
#: for some thousand. Fixed for the life of a checkpoint.
STATE_BUCKETS = 1024


def dedupe_in_state(requests: DataFrame, key: str = "request_key", ts: str = "ts",
                    order: str = "event_id", ttl_s: int = V.DEDUPE_TTL_S,
                    buckets: int = STATE_BUCKETS) -> DataFrame:
    """Stream of requests -> the same rows with anchor_id and duplicate, from a state store.

    The last anchors of the keys of one hash bucket are one value. An anchor is forgotten when the
    watermark has passed the end of its life and its bucket gets rows, or at the bucket's timer,
    which stands at the end of its latest anchor; no log is read, and a batch touches the buckets of
    its own rows only. Rows of a key are settled in time order within a batch. A row that arrives out of
    order across batches is judged by the anchor known then, and dropped if it is later than a TTL:
    ``dedupe_to_files`` keeps such rows. Rows without key or time are never duplicates.
    """
    keyed = F.nullif(F.col(key).cast("string"), F.lit("")).isNotNull() & F.col(ts).isNotNull()
    kind = dict(requests.dtypes)[order]
    schema = T.StructType([*requests.schema.fields, *T.StructType.fromDDL(
        f"anchor_id {kind}, duplicate boolean").fields])
    timed = requests.where(keyed).withColumns({
        "__key": F.col(key).cast("string"), "__t": _micros(ts),
        "__time": F.col(ts).cast("timestamp")}).withWatermark("__time", f"{ttl_s} seconds")
    bucket = F.pmod(F.xxhash64("__key"), F.lit(buckets)).cast("int")
    settled = timed.withColumn("__bucket", bucket).groupBy("__bucket").transformWithStateInPandas(
        _Anchors(ttl_s * 1_000_000, order, kind, requests.columns), schema, "Append", "EventTime")
    loose = requests.where(F.coalesce(~keyed, F.lit(True))).select(
        *requests.columns, F.col(order).alias("anchor_id"), F.lit(False).alias("duplicate"))
    return settled.unionByName(loose)


class _Anchors(StatefulProcessor):
    """The last anchor of each key of a bucket: its time in microseconds and its order value."""

    def __init__(self, ttl: int, order: str, kind: str, columns: list[str]):
        self.ttl, self.order, self.kind, self.columns = ttl, order, kind, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.anchors = handle.getValueState(
            "anchors", f"k array<string>, t array<bigint>, id array<{self.kind}>")

    def _timer(self, known: dict) -> int | None:
        """The moment when the latest anchor's life is over, in milliseconds."""
        return (max(t for t, _ in known.values()) + self.ttl) // 1000 + 1 if known else None

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        # the rows of one bucket in one batch; the order of chunks says nothing about time
        batch = pd.concat(list(rows), ignore_index=True)
        batch.columns = [*self.columns, "__key", "__t", "__time", "__bucket"]   # names with _ come as places
        batch = batch.sort_values(["__t", self.order], kind="stable", na_position="first",
                                  ignore_index=True)
        stored = self.anchors.get()
        before = {k: (t, i) for k, t, i in zip(*stored)} if stored is not None else {}
        known, ids, repeats = dict(before), [], []
        for k, t, own in zip(batch["__key"].tolist(), batch["__t"].tolist(), batch[self.order].tolist()):
            anchor = known.get(k)
            repeat = anchor is not None and anchor[0] <= t <= anchor[0] + self.ttl
            if not repeat:
                known[k] = anchor = (t, own)
            ids.append(anchor[1])
            repeats.append(repeat)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known = {k: a for k, a in known.items() if a[0] + self.ttl >= passed}
        if known != before:
            old, new = self._timer(before), self._timer(known)
            if old != new and old is not None:
                self.handle.deleteTimer(old)
            if old != new and new is not None:
                self.handle.registerTimer(new)
            if known:
                self.anchors.update(
                    (list(known), [t for t, _ in known.values()], [i for _, i in known.values()]))
            else:
                self.anchors.clear()
        yield batch[self.columns].assign(anchor_id=ids, duplicate=repeats)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.anchors.clear()
        return iter([])

    def close(self) -> None:
        pass


def dedupe_state_to_files(requests: DataFrame, path: str, checkpoint: str, **options
                          ) -> DataStreamWriter:
    """``dedupe_in_state`` appended to files. Needs the RocksDB state store, which it sets for the
    session, and protobuf on the executors."""
    requests.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    results = dedupe_in_state(requests, **options)
    return _available(results.writeStream.format("parquet").outputMode("append")
                      .option("path", path), checkpoint)


# --- queue ---------------------------------------------------------------------------------
KEY_FOLDERS = 64


def enqueue_batch(batch: DataFrame, batch_id: int, path: str, order: tuple) -> None:
    """Append the escalations of one micro-batch whose key is not queued yet.

    The queue lies in folders by key hash; only those of the batch's own keys are read.
    """
    batch = batch.persist()
    try:
        part = F.pmod(F.xxhash64(idempotency_key()), F.lit(KEY_FOLDERS)).cast("int")
        # at most KEY_FOLDERS numbers; this one pass also fills the cache for the branches below
        parts = [r[0] for r in batch.select(part).distinct().collect()]
        existing = _log_before(batch.sparkSession, path, batch_id)
        if existing is not None:
            existing = existing.where(F.col("part").isin(parts))
        new = enqueue(batch, existing, order)
        _append_batch(new.withColumn("part", part), path, "part", batch_id)
    finally:
        batch.unpersist()


def enqueue_to_files(results: DataFrame, path: str, checkpoint: str,
                     order: tuple = ("received_at",)) -> DataStreamWriter:
    return _available(results.writeStream.foreachBatch(
        lambda batch, batch_id: enqueue_batch(batch, batch_id, path, order)), checkpoint)
