"""Registered queries: what files keep of the given tables, written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import audit
from ..operators import guardrail as G
from ..operators import retrieval as H
from ..operators import rules as R
from ..session import checkpoint_dir
from ..sources import labelled, sinks
from ..sources.templates import with_template_versions
from . import oracle_parts as O
from . import views
from .catalog_cases import DECISION_CTES, decided, latest_templates_query, state
from .catalog_cases import ORACLE as CASES
from .catalog_guardrail import HIT_CTES
from .registry import registry

QUERIES, ORACLE, register = registry()


def _folder(spark) -> str:
    """A fresh folder where all executors can read and write."""
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@register("labelled_messages", """
select 'E' || d.doc_id as id, md5(text) as body_md5,
  case when toxic = 1 or quality = 0 then 'HITL' else 'AUTO_SEND' end as verdict,
  case when d.doc_id % 10 = 0 then 'injection' else '' end as attack_type
from documents d join labels using (doc_id)""")
def labelled_messages(spark, sf):
    """Labelled documents as JSON lines, every tenth one in the adversarial file."""
    i = F.col("doc_id")
    docs = views.text_table(spark, sf, "documents", "doc_id").join(
        views.table(spark, sf, "labels"), "doc_id")
    rows = docs.select(
        "doc_id", F.concat(F.lit("E"), i.cast("string")).alias("id"),
        F.col("text").alias("email_body"),
        F.struct(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "HITL")
                 .otherwise("AUTO_SEND").alias("verdict")).alias("expected"),
        F.when(i % 10 == 0, "injection").alias("attack_type"))
    folder = _folder(spark)
    rows.where(i % 10 != 0).drop("doc_id").write.json(f"{folder}/labelled")
    rows.where(i % 10 == 0).drop("doc_id").write.json(f"{folder}/adversarial")
    read = labelled.read_labelled(spark, f"{folder}/labelled", f"{folder}/adversarial")
    return read.select("id", F.md5("email_body").alias("body_md5"), "expected.verdict",
                       F.coalesce("attack_type", F.lit("")).alias("attack_type"))


@register("run_metrics_log", O.with_ctes(O.CALLS, final="""
select cast(user_id as varchar) as message_id, ts as timestamp_utc, action, tokens_in, tokens_out,
  round(tokens_in * 0.4::double / 1e6 + tokens_out * 1.6::double / 1e6, 6) as cost_usd,
  cast(ts as date) as run_date from calls"""))
def run_metrics_log(spark, sf):
    """Two runs appended to one log."""
    calls = views.calls(spark, sf).withColumns({
        "message_id": F.col("user_id").cast("string"),
        "timestamp_utc": F.col("ts").cast("timestamp")})
    folder = _folder(spark)
    for run in (0, 1):
        sinks.write_run_metrics(calls.where(F.col("event_id") % 2 == run), folder)
    return sinks.read_run_metrics(spark, folder).select(
        "message_id", "timestamp_utc", "action", "tokens_in", "tokens_out", "cost_usd", "run_date")


@register("compacted_metrics_log", ORACLE["run_metrics_log"])
def compacted_metrics_log(spark, sf):
    """Three runs appended to a log of versions, merged in between."""
    calls = views.calls(spark, sf).withColumns({
        "message_id": F.col("user_id").cast("string"),
        "timestamp_utc": F.col("ts").cast("timestamp")})
    folder = _folder(spark)
    for run in range(3):
        sinks.log_run_metrics(calls.where(F.col("event_id") % 3 == run), folder)
        if run == 1:
            sinks.compact_run_metrics(spark, folder)
    return sinks.logged_run_metrics(spark, folder).select(
        "message_id", "timestamp_utc", "action", "tokens_in", "tokens_out", "cost_usd", "run_date")


#: The run-metrics columns before the judge's single scores were added.
_EARLIER = tuple(c for c in V.RUN_METRICS_COLUMNS if not c[0].startswith("judge_"))


@register("metrics_of_two_schemas", O.with_ctes(O.CALLS, final="""
select cast(user_id as varchar) as message_id, ts as timestamp_utc, action, tokens_in,
  case when event_id % 2 = 0 then 'earlier' else 'now' end as written_as,
  case when event_id % 2 = 1 then event_id % 5 end as judge_ton from calls"""))
def metrics_of_two_schemas(spark, sf):
    """Runs under two column lists in one folder, each read back by its version, as one table."""
    calls = views.calls(spark, sf).withColumns({
        "message_id": F.col("user_id").cast("string"), "judge_ton": F.col("event_id") % 5,
        "timestamp_utc": F.col("ts").cast("timestamp")})
    folder = _folder(spark)
    even = F.col("event_id") % 2 == 0
    sinks.write_run_metrics(calls.where(even), folder, _EARLIER)
    sinks.write_run_metrics(calls.where(~even), folder)
    now = sinks.read_run_metrics(spark, folder)
    earlier = sinks.read_run_metrics(spark, folder, sinks.schema_version(_EARLIER))
    return now.withColumn("written_as", F.lit("now")).unionByName(
        audit.align_schema(earlier, now.schema).withColumn("written_as", F.lit("earlier"))).select(
        "message_id", "timestamp_utc", "action", "tokens_in", "written_as",
        F.col("judge_ton").cast("long").alias("judge_ton"))


@register("audit_snapshot", O.with_ctes(*DECISION_CTES, final="""
select case_id, status, (select count(*) from decisions) as n_decisions from state"""))
def audit_snapshot(spark, sf):
    """The case table and its decisions written as one snapshot, over a former one."""
    log = decided(spark, sf)[0]
    cases = state(spark, sf, log).withColumn("email_from", F.lit("a@b.example"))
    allowed = cases.limit(1).select("email_from")
    path = f"{_folder(spark)}/snapshot"
    for rows in (log.limit(0), log):
        audit.export_snapshot(cases, rows, allowed, path)
    kept, decisions = audit.read_snapshot(spark, path)
    return kept.select("case_id", "status", F.lit(decisions.count()).alias("n_decisions"))


@register("evaluation_files", """
select conv_id, turn, md5(text) as text_md5, 'a "quoted", text | ' || role as notes from conversations""")
def evaluation_files(spark, sf):
    """Evaluation detail as CSV, with quotes, commas and line breaks in its texts."""
    turns = views.table(spark, sf, "conversations").select(
        "conv_id", "turn", "text",
        F.array(F.lit('a "quoted", text'), F.col("role")).alias("notes"))
    folder = _folder(spark)
    sinks.write_eval(turns, turns.groupBy("notes").count(), folder)
    read = spark.read.options(header=True, escape='"', multiLine=True).csv(f"{folder}/detail")
    return read.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                       F.md5("text").alias("text_md5"), "notes")


@register("audit_file", O.with_ctes(*DECISION_CTES, final="""
select case_id, s.status, coalesce(d.decision, '') as decision, coalesce(d.comment, '') as comment,
  (select count(*) from state left join decisions using (case_id)) as written
from state s left join decisions d using (case_id)"""))
def audit_file(spark, sf):
    """The audit export as a file, with the count that writing it reported."""
    log = decided(spark, sf)[0]
    path = f"{_folder(spark)}/audit"
    written = audit.write_audit(audit.audit_export(state(spark, sf, log), log), path)
    read = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    blank = F.lit("")
    return read.select(F.col("case_id").cast("long"), "status",
                       F.coalesce("decision", blank).alias("decision"),
                       F.coalesce("comment", blank).alias("comment"),
                       F.lit(written).cast("long").alias("written"))


@register("template_versions", f"""
with latest as ({CASES["latest_templates"]})
select l.name, (select version from latest order by name limit 1) as tpl_first,
  (select version from latest order by name desc limit 1) as tpl_last from latest l""")
def template_versions(spark, sf):
    """Every result row with the versions of two agents' templates."""
    chosen = latest_templates_query(spark, sf)
    ends = chosen.agg(F.min("name"), F.max("name")).first()
    rows = with_template_versions(chosen.select("name"), chosen, tuple(ends))
    return rows.select("name", F.col(f"`tpl_{ends[0]}`").alias("tpl_first"),
                       F.col(f"`tpl_{ends[1]}`").alias("tpl_last"))


_CODES = ", ".join(f"({O.lit(code)}, {O.lit(why)})" for code, why in (
    *[(label, why) for label, _, why in V.INPUT_RULES], *V.STRUCTURAL_REASONS))


@register("rules_in_force", O.with_ctes(*HIT_CTES, final=f"""
select code, why, count(rule) as messages from (values {_CODES}) as r(code, why)
left join (select unnest(string_split(rules, '+')) as rule from hits where rules <> '')
  on code = split_part(rule, ':', 1) group by code, why"""))
def rules_in_force(spark, sf):
    """Every input rule with its reason and how many messages it reaches."""
    hits = R.with_input_hits(G.with_sensitive_entities(views.messages(spark, sf)))
    found = hits.select(F.explode("input_hits").alias("rule")).groupBy(
        F.split_part("rule", F.lit(":"), F.lit(1)).alias("code")).agg(F.count("*").alias("messages"))
    rules = R.rule_catalogue(spark, output=False)
    return rules.join(found, "code", "left").select(
        "code", "why", F.coalesce("messages", F.lit(0)).alias("messages"))


@register("corpus_passages", """
select source || '-' || (i - 1) as chunk_id, md5(trim(parts[i])) as text_md5, split_part(trim(parts[i]), chr(10), 1) as section
from (select source, parts, unnest(range(1, len(parts) + 1)) as i from (
  select source, [source || ': ' || n] || list_transform(langs, lambda l: l || chr(10) || 'Text in ' || l) as parts from (
    select source, count(*) as n, list_sort(list(distinct lang)) as langs from documents group by source)))""")
def corpus_passages(spark, sf):
    """One markdown file for each source, with a section for each of its languages."""
    langs = F.array_sort(F.collect_set("lang"))
    section = F.transform(langs, lambda l: F.concat(F.lit("## "), l, F.lit("\nText in "), l))
    pages = views.table(spark, sf, "documents").groupBy("source").agg(
        F.concat(F.lit("# "), "source", F.lit(": "), F.count("*").cast("string"), F.lit("\n"),
                 F.array_join(section, "\n")).alias("text"))
    folder = _folder(spark)
    (pages.repartition(1).write.partitionBy("source").option("lineSep", "\n").text(folder))
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"/source=([^/]+)/", 1).alias("source"),
        F.col("value").alias("text"))
    chunks = H.chunk_sections(files)
    return chunks.select("chunk_id", F.md5(F.regexp_replace("text", "^# ", "")).alias("text_md5"),
                         "section")
