"""Registered queries: the same work on streams, checked against the answer on tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..session import checkpoint_dir
from ..sources import sinks
from ..streaming import jobs
from . import views
from .catalog_cases import ORACLE as CASES
from .catalog_guardrail import JUDGED_CTES
from .catalog_guardrail import ORACLE as GUARDRAIL
from . import oracle_parts as O
from .registry import registry

QUERIES, ORACLE, register = registry()


def _work_folder(spark) -> str:
    """A fresh folder where all executors can read and write."""
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


BATCHES = 4


def _stream(spark, sf, name):
    schema = views.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


def _parts(rows, order):
    """BATCHES parts of the rows that follow each other in order; rows without it come first."""
    shares = ", ".join(str(i / BATCHES) for i in range(1, BATCHES))
    cuts = rows.selectExpr(f"percentile_approx({order}, array({shares}), 1000)").first()[0] or []
    o = F.col(order)
    for low, high in zip([None, *cuts], [*cuts, None]):
        above = F.lit(True) if low is None else o > F.lit(low)
        upto = F.lit(True) if high is None else o <= F.lit(high)
        yield rows.where(F.coalesce(above & upto, F.lit(low is None)))


def _in_batches(spark, sf, name, order, folder, job):
    """Run the job that job(stream) gives over the table in several micro-batches that follow each
    other in order: one run for each part, and a run takes all files that are new."""
    rows = views.table(spark, sf, name)
    rows.limit(0).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    for part in _parts(rows, order):
        part.write.mode("append").parquet(f"{folder}/in")
        job(stream).start().awaitTermination()


def _messages(spark, sf, documents=None):
    if documents is None:
        documents = _stream(spark, sf, "documents")
    return views.judged(views.drafted(views.classified(views.messages_from(documents))))


@register("stream_triage_decisions", GUARDRAIL["triage_decisions"])
def stream_triage_decisions(spark, sf):
    folder = _work_folder(spark)
    columns = ["doc_id", "message_id", "categorie", "priorite", "action", "requires_human",
               "decision_reason"]
    jobs.triage_to_files(_messages(spark, sf), f"{folder}/out", f"{folder}/state", columns,
                         spread=spark.sparkContext.defaultParallelism).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@register("stream_dedupe_ttl", CASES["dedupe_ttl"])
def stream_dedupe_ttl(spark, sf):
    folder = _work_folder(spark)
    _in_batches(spark, sf, "events", "ts", folder, lambda events: jobs.dedupe_to_files(
        views.requests_from(events).drop("body"), f"{folder}/out", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/out/results").select(
        "event_id", "anchor_id", "duplicate")


@register("stream_dedupe_state", CASES["dedupe_ttl"])
def stream_dedupe_state(spark, sf):
    """The same from a state store; every part is taken up by a new run of the stream."""
    folder = _work_folder(spark)
    _in_batches(spark, sf, "events", "ts", folder, lambda events: jobs.dedupe_state_to_files(
        views.requests_from(events).drop("body"), f"{folder}/out", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/out").select("event_id", "anchor_id", "duplicate")


@register("stream_enqueued_cases", CASES["enqueued_cases"])
def stream_enqueued_cases(spark, sf):
    from .triage import triage
    folder = _work_folder(spark)
    spread = 4 * spark.sparkContext.defaultParallelism

    def job(documents):
        # a part comes in few files, which as few tasks read: dealt out before the patterns run
        dealt = documents.repartition(spread)
        results = triage(_messages(spark, sf, dealt), texts=False).select(
            "doc_id", "message_id", "job_id", "received_at", "requires_human", "decision_reason")
        return jobs.enqueue_to_files(results, f"{folder}/out", f"{folder}/state",
                                     ("received_at", "doc_id"))
    _in_batches(spark, sf, "documents", "doc_id", folder, job)
    return spark.read.parquet(f"{folder}/out").select("doc_id", "case_key", "decision_reason")


_FOUND = ", ".join(f"case when b_{e} + s_{e} > 0 then '{e}=' || (b_{e} + s_{e}) end"
                   for e in V.PII_PATTERNS)


@register("stream_run_metrics", O.with_ctes(*JUDGED_CTES, final=f"""
select received_at as timestamp_utc, coalesce(job_id, '') as job_id, coalesce(message_id, '') as message_id,
  categorie, priorite, round(confiance, 3) as confiance,
  case when degenerate then 0 else {" + ".join(f"b_{e} + s_{e}" for e in V.PII_PATTERNS)} + n_name end as pii_total,
  case when degenerate then '' else concat_ws(';', {_FOUND}, case when n_name > 0 then 'NOM=' || n_name end) end as pii_entities,
  case when degenerate then 'none' else 'regex' end as pii_engine, judge_verdict,
  pertinence as judge_pertinence, ton as judge_ton, conformite as judge_conformite,
  factualite as judge_factualite, round(case when doc_id % 41 = 0 then 0 else raw_score end, 3) as judge_score,
  cast(null as int) as drafter_retries, action, action <> 'AUTO' as requires_human, decision_reason,
  doc_id % 2000 as tokens_in, doc_id % 500 as tokens_out,
  round((doc_id % 2000) * 0.4::double / 1e6 + (doc_id % 500) * 1.6::double / 1e6, 6) as cost_usd,
  '' as human_decision, cast(null as bigint) as duration_ms, cast(null as varchar) as errors,
  cast(null as varchar) as tpl_classifier, cast(null as varchar) as tpl_drafter,
  cast(null as varchar) as tpl_judge from decided"""))
def stream_run_metrics(spark, sf):
    from .triage import triage
    folder = _work_folder(spark)
    i = F.col("doc_id")
    results = triage(_messages(spark, sf)).withColumns({
        "timestamp_utc": F.col("received_at").cast("timestamp"),
        "tokens_in": i % 2000, "tokens_out": i % 500})
    jobs.metrics_to_files(results, f"{folder}/out", f"{folder}/state").start(
        ).awaitTermination()
    return sinks.read_run_metrics(spark, f"{folder}/out").select(
        *[name for name, _ in V.RUN_METRICS_COLUMNS])


_HOURS = """select time_bucket(interval 1 hour, ts) as window_start, count(*) as n,
  count(*) filter (where action = 'AUTO') as n_auto, count(*) filter (where action <> 'AUTO') as n_escalated,
  cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out,
  round(cast(sum(tokens_in) as double) * 0.4 / 1e6 + cast(sum(tokens_out) as double) * 1.6 / 1e6, 6) as cost_usd,
  round(cast(count(*) filter (where action <> 'AUTO') as double) / count(*), 6) as escalation_rate
from calls group by 1"""


def _hour(df):
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("metrics_by_hour", O.with_ctes(O.CALLS, final=_HOURS))
def metrics_by_hour(spark, sf):
    """All hours with all their calls."""
    return _hour(jobs.metrics_by_hour(views.calls(spark, sf)))


@register("stream_metrics_by_hour", O.with_ctes(O.CALLS, final=_HOURS + """
having time_bucket(interval 1 hour, any_value(ts)) + interval 1 hour <= (select max(ts) from calls) - interval 10 minute"""))
def stream_metrics_by_hour(spark, sf):
    """The part of ``metrics_by_hour`` whose windows the watermark has closed."""
    folder = _work_folder(spark)
    hours = jobs.metrics_by_hour(views.calls_from(_stream(spark, sf, "events")))
    (hours.writeStream.format("parquet").outputMode("append")
     .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return _hour(spark.read.parquet(f"{folder}/out"))
