"""Registered queries: model input and output, evaluation, run metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.json_columns import from_json_col, to_json_col
from ..operators import evaluation as E
from ..operators import guardrail as G
from ..operators import model_io as D
from . import completions
from . import oracle_parts as O
from . import sample_values as S
from . import views
from .catalog_guardrail import GUARDED_CTES, JUDGED_CTES, triage_input
from .triage import triage
from .registry import registry

QUERIES, ORACLE, register = registry()


# --- prompts -----------------------------------------------------------------------------------
def _prompt_input(spark, sf):
    df = views.drafted(views.classified(G.mask_messages(views.messages(spark, sf))))
    i = F.col("doc_id")
    return df.withColumns({
        "resume": F.col("lang"),
        "contexts": F.when(i % 3 == 0, F.array(F.lit("[a] un"), F.lit("[b] deux"))),
        "critic_feedback": F.when(i % 4 == 0, F.lit("trop long")),
        "critic_approved": i % 8 == 0,
        "critic_issues": F.array(F.lit("ton"), F.lit("longueur")),
    })


_PROMPTED = (*GUARDED_CTES, O.classified("guarded", "c0"), O.drafted("c0", "c1"))
_HEAD = ("'sender: ' || coalesce(nullif(email_from_llm, ''), 'unknown') || chr(10) || 'subject: ' "
         f"|| subject_masked || chr(10) || 'body: ' || {O.strip('body_masked')}")
_CLASS = "'category: ' || categorie || chr(10) || 'priority: ' || priorite"


@register("classifier_prompts", O.with_ctes(*_PROMPTED, final=f"""
select doc_id, md5({_HEAD}) as prompt_md5 from c1
where not degenerate and {O.strip("body_masked")} <> ''"""))
def classifier_prompts(spark, sf):
    return D.prompts_for(_prompt_input(spark, sf), "classifier").select(
        "doc_id", F.md5("prompt").alias("prompt_md5"))


@register("drafter_prompts", O.with_ctes(*_PROMPTED, final=f"""
select doc_id, md5({_HEAD} || chr(10) || {_CLASS} || chr(10) || 'summary: ' || lang || chr(10)
  || 'passages: ' || case when doc_id % 3 = 0 then '[a] un / [b] deux' else 'none' end || chr(10)
  || case when doc_id % 4 = 0 and doc_id % 8 <> 0
    then 'refused before: trop long; ton, longueur' || chr(10) else '' end
  || {O.lit(D.ANSWER_NOTE)}) as prompt_md5 from c1 where not degenerate"""))
def drafter_prompts(spark, sf):
    return D.prompts_for(_prompt_input(spark, sf), "drafter").select(
        "doc_id", F.md5("prompt").alias("prompt_md5"))


@register("judge_prompts", O.with_ctes(*_PROMPTED, final=f"""
select doc_id, md5('body: ' || {O.strip("body_masked")} || chr(10) || {_CLASS} || chr(10)
  || 'draft: ' || draft) as prompt_md5
from c1 where not degenerate and trim(draft) <> ''"""))
def judge_prompts(spark, sf):
    return D.prompts_for(_prompt_input(spark, sf), "judge").select(
        "doc_id", F.md5("prompt").alias("prompt_md5"))


@register("batch_inference", O.with_ctes(*_PROMPTED, final=f"""
select doc_id, 'demande' as categorie, 0.9::double as confiance, length({_HEAD}) // 4 as tokens_in,
  12::bigint as tokens_out
from c1 where not degenerate and {O.strip("body_masked")} <> ''"""))
def batch_inference(spark, sf):
    """Classifier prompts of all messages through the batch hook, with a stand-in model."""
    def call(batches):
        import pandas as pd
        for batch in batches:
            size = batch["prompt"].str.len()
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "completion": '{"categorie": "demande", "confiance": 0.9}',
                "tokens_in": size // 4, "tokens_out": 12})

    prompts = D.prompts_for(_prompt_input(spark, sf), "classifier").select("doc_id", "prompt")
    answers = D.infer(
        prompts, call, "doc_id long, completion string, tokens_in long, tokens_out long")
    valid, _ = D.parse_classification(answers)
    return valid.select("doc_id", "categorie", "confiance", "tokens_in", "tokens_out")


# --- completions -------------------------------------------------------------------------------
def _fill(template, replacements):
    out = template
    for mark, value in replacements.items():
        out = F.replace(out, F.lit(mark), value)
    return out


def _raw(spark, sf, templates, marks):
    e = F.col("event_id")
    return views.text_table(spark, sf, "events", "event_id").select(
        "event_id", _fill(views.pick(templates, e), marks(e)).alias("completion"))


def _raw_sql(templates, marks: dict[str, str]) -> str:
    text = O.pick(templates, "event_id")
    for mark, value in marks.items():
        text = f"replace({text}, '{mark}', {value})"
    return f"raw as (select event_id, {text} as completion from events)"


def _classifier_raw(spark, sf):
    return _raw(spark, sf, completions.CLASSIFIER, lambda e: {
        "__C__": views.pick(S.CATEGORY_CYCLE, e),
        "__N__": F.lpad((e % 100).cast("string"), 2, "0")})


def _judge_raw(spark, sf):
    return _raw(spark, sf, completions.JUDGE, lambda e: {
        f"__{m}__": (1 + F.floor(e / n) % 5).cast("string")
        for m, n in (("A", 2), ("B", 3), ("C", 5), ("D", 7))})


_CLASSIFIER_RAW = _raw_sql(completions.CLASSIFIER, {
    "__C__": O.pick(S.CATEGORY_CYCLE, "event_id"),
    "__N__": "lpad(cast(event_id % 100 as varchar), 2, '0')"})
_JUDGE_RAW = _raw_sql(completions.JUDGE, {
    f"__{m}__": f"cast(1 + (event_id // {n}) % 5 as varchar)"
    for m, n in (("A", 2), ("B", 3), ("C", 5), ("D", 7))})

_CLASSIFIED_RAW = (
    _CLASSIFIER_RAW,
    "typed as (select *, case when json_valid(completion) then completion end as j from raw)",
    """conf as (select *, case
  when json_type(j) <> 'OBJECT' or j is null then null
  when json_type(j, '$.confiance') is null or json_type(j, '$.confiance') = 'NULL' then 0.0
  when json_type(j, '$.confiance') = 'BOOLEAN' then case when j ->> '$.confiance' = 'true' then 1.0 else 0.0 end
  else try_cast(j ->> '$.confiance' as double) end as c from typed)""",
    f"""fields as (select event_id, c is not null as usable,
  case when c is null or json_type(j, '$.categorie') is null then 'autre' else j ->> '$.categorie' end as categorie,
  case when c is null or json_type(j, '$.priorite') is null then 'normale' else j ->> '$.priorite' end as priorite,
  case when c is null or json_type(j, '$.resume') is null then '' else j ->> '$.resume' end as resume,
  case when c is null then '' else coalesce(j ->> '$.expediteur', '') end as expediteur,
  coalesce(c, 0.0) as confiance,
  case when c is null then '[classifier] unusable output' else '' end as classifier_error,
  concat_ws(',', case when c is not null and json_type(j, '$.resume') not in ('VARCHAR') then 'resume' end) as wrong
  from conf)""",
    f"""contract as (select *, concat_ws(',', nullif(wrong, ''),
  case when categorie not in ({", ".join(O.lit(c) for c in V.CATEGORIES)}) then 'categorie' end,
  case when priorite not in ({", ".join(O.lit(c) for c in V.PRIORITIES)}) then 'priorite' end,
  case when confiance not between 0 and 1 then 'confiance' end) as violation from fields)""",
)


@register("parsed_classifications", O.with_ctes(*_CLASSIFIED_RAW, final="""
select event_id, categorie, priorite, resume, expediteur, cast(confiance as double) as confiance, classifier_error
from contract where violation = ''"""))
def parsed_classifications(spark, sf):
    valid, _ = D.parse_classification(_classifier_raw(spark, sf))
    return valid.select(
        "event_id", "categorie", "priorite", "resume",
        F.coalesce("expediteur", F.lit("")).alias("expediteur"), "confiance",
        F.coalesce("classifier_error", F.lit("")).alias("classifier_error"))


@register("quarantined_classifications", O.with_ctes(*_CLASSIFIED_RAW, final="""
select event_id, violation from contract where violation <> ''"""))
def quarantined_classifications(spark, sf):
    return D.parse_classification(_classifier_raw(spark, sf))[1].select("event_id", "violation")


_SCORE_SQL = ("case when json_type(j, '$.{c}') in ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') "
              "then try_cast(j ->> '$.{c}' as double) end as {c}_n")
_JUDGED_RAW = (
    _JUDGE_RAW,
    "typed as (select *, case when json_valid(completion) then completion end as j from raw)",
    "nums as (select *, " + ", ".join(_SCORE_SQL.format(c=c) for c in V.JUDGE_CRITERIA)
    + ", coalesce(json_type(j) = 'OBJECT', false) as is_object from typed)",
    "ok as (select *, is_object and " + " and ".join(
        f"coalesce({c}_n = floor({c}_n) and {c}_n between 1 and 5, false)"
        for c in V.JUDGE_CRITERIA)
    + """ and coalesce(j ->> '$.verdict' in ('AUTO_SEND', 'HUMAN_REVIEW', 'REJECT'), false)
  and coalesce(json_type(j, '$.feedback'), 'VARCHAR') = 'VARCHAR'
  and coalesce(json_type(j, '$.issues[0]'), 'VARCHAR') = 'VARCHAR' as valid from nums)""",
    """parsed as (select event_id, valid, is_object,
  case when valid then j ->> '$.verdict' else 'HUMAN_REVIEW' end as judge_verdict,
  case when valid then (pertinence_n + ton_n + conformite_n + factualite_n) / 20 else 0.0 end as critic_score,
  case when valid then coalesce(j ->> '$.feedback', '') else 'judge_output_unusable' end as critic_feedback,
  case when valid then coalesce(j ->> '$.issues[0]', '') else 'judge_invalid_output' end as issues from ok)""",
)


@register("parsed_judgements", O.with_ctes(*_JUDGED_RAW, final="""
select event_id, judge_verdict, cast(critic_score as double) as critic_score,
  valid and judge_verdict = 'AUTO_SEND' and critic_score >= 0.75 as critic_approved, critic_feedback, issues
from parsed"""))
def parsed_judgements(spark, sf):
    return D.parse_judge(_judge_raw(spark, sf)).select(
        "event_id", "judge_verdict", "critic_score", "critic_approved", "critic_feedback",
        F.array_join("critic_issues", "+").alias("issues"))


@register("judge_outage_open", O.with_ctes(*_JUDGED_RAW, final="""
select event_id, not is_object or (valid and judge_verdict = 'AUTO_SEND' and critic_score >= 0.75) as critic_approved,
  cast(case when is_object then critic_score else 0.5 end as double) as critic_score from parsed"""))
def judge_outage_open(spark, sf):
    return D.parse_judge(_judge_raw(spark, sf), outage="open").select(
        "event_id", "critic_approved", "critic_score")


_SUM = "cast(pertinence + ton + conformite + factualite as double) / 20"


@register("approvals", O.with_ctes(
    O.MESSAGES, O.drafted("messages"), O.judged("drafted"), final=f"""
select doc_id, case when trim(draft) = '' then 0.0 else {_SUM} end as critic_score,
  trim(draft) <> '' and judge_verdict = 'AUTO_SEND' and {_SUM} >= 0.75 as critic_approved,
  case when trim(draft) = '' then 'empty_draft' else '' end as critic_issue from judged"""))
def approvals(spark, sf):
    df = views.judged(views.drafted(views.messages(spark, sf)))
    return D.approve(df).select("doc_id", "critic_score", "critic_approved", "critic_issue")


@register("rubric_conflicts", O.with_ctes(
    O.MESSAGES, O.drafted("messages"), O.judged("drafted"), final="""
select doc_id, judge_verdict, case when least(pertinence, ton, conformite, factualite) >= 4 then 'AUTO_SEND'
  when least(pertinence, ton, conformite, factualite) = 3 then 'HUMAN_REVIEW' else 'REJECT' end as rubric_verdict,
  doc_id % 13 = 0 as rubric_conflict from judged"""))
def rubric_conflicts(spark, sf):
    df = views.judged(views.drafted(views.messages(spark, sf)))
    return D.rubric_check(df).select(
        "doc_id", "judge_verdict", "rubric_verdict", "rubric_conflict")


@register("final_attempts", O.with_ctes(O.ATTEMPTS, final="""
select conv_id, attempt, critic_approved, drafter_retries from (
  select *, row_number() over (partition by conv_id order by attempt) as n,
    case when critic_approved then row_number() over (partition by conv_id order by attempt) - 1
      else row_number() over (partition by conv_id order by attempt) end as drafter_retries
  from attempts) a
where n <= 2 and n = (select coalesce(min(case when b.critic_approved then b.n end), max(b.n)) from (
  select conv_id, critic_approved, row_number() over (partition by conv_id order by attempt) as n from attempts) b
  where b.conv_id = a.conv_id and b.n <= 2)"""))
def final_attempts(spark, sf):
    return D.final_attempt(views.attempts(spark, sf)).select(
        "conv_id", "attempt", "critic_approved", F.col("drafter_retries").cast("long")
        .alias("drafter_retries"))


@register("usage_totals", O.with_ctes(O.ATTEMPTS, final="""
select conv_id, coalesce(sum(tokens_in), 0)::bigint as tokens_in, coalesce(sum(tokens_out), 0)::bigint as tokens_out,
  count(tokens_in) as llm_calls from (select distinct conv_id from conversations) left join attempts using (conv_id)
group by conv_id"""))
def usage_totals(spark, sf):
    every = views.table(spark, sf, "conversations").select("conv_id").distinct()
    return D.usage_totals(every, views.attempts(spark, sf))


@register("baseline_classifier")
def baseline_classifier(spark, sf):
    """Quality label of documents predicted from their words; all documents are scored."""
    docs = views.text_table(spark, sf, "documents", "doc_id").select("doc_id", "text")
    labelled = docs.join(views.table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text", F.col("quality").cast("string").alias("label"))
    model = D.train_classifier(labelled)
    return D.score_classifier(model, docs).select("doc_id", "categorie", "confiance")


@register("json_columns", """
select event_id, case when event_id % 10 = 0 then -1 else cast(props ->> '$.k' as bigint) end as k,
  case when event_id % 10 = 0 then '{}' else '{"k":"' || (props ->> '$.k') || '"}' end as encoded from events""")
def json_columns(spark, sf):
    """Props as JSON text; every tenth one is damaged and falls back to the empty map."""
    e = F.col("event_id")
    text = F.when(e % 10 == 0, F.substr("props", F.lit(2))).otherwise(F.col("props"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    df = views.table(spark, sf, "events").select(
        "event_id", from_json_col(text, "map<string,string>", none).alias("m"))
    return df.select(
        "event_id", F.coalesce(F.try_element_at("m", F.lit("k")).cast("long"), F.lit(-1))
        .alias("k"), to_json_col("m").alias("encoded"))


# --- evaluation --------------------------------------------------------------------------------
FORBIDDEN = (("code promo", r"https?://"), ("rembours\\w*",), ("en tant qu", "IA"))
REQUIRED = (("bonjour",), ("conseiller|dossier",), ())


def _checks(spark, sf):
    i = F.col("doc_id")

    def lists(options):
        arrays = [F.array(*[F.lit(p) for p in o]).cast("array<string>") for o in options]
        return F.element_at(F.array(*arrays), (i % len(options)).cast("int") + 1)

    return views.table(spark, sf, "labels").select(
        "doc_id", lists(FORBIDDEN).alias("forbidden"), lists(REQUIRED).alias("required"),
        (i % 11 == 0).alias("must_be_empty"))


def _sql_lists(options) -> str:
    # The checking engine matches \\w on ASCII only, which is enough for these patterns.
    arrays = ", ".join("[" + ", ".join(O.lit(p) for p in o) + "]::varchar[]" for o in options)
    return f"([{arrays}])[cast(doc_id % {len(options)} as int) + 1]"


_CHECKED = f"""specs as (select doc_id, {_sql_lists(FORBIDDEN)} as forbidden,
  {_sql_lists(REQUIRED)} as required, doc_id % 11 = 0 as must_be_empty from labels),
checked as (select d.*, coalesce(concat_ws(';', case when must_be_empty and trim(draft) <> '' then 'draft_non_vide' end,
  nullif(array_to_string(list_transform(list_filter(forbidden, lambda p: regexp_matches(draft, '(?i)' || p)),
    lambda p: 'interdit:' || p), ';'), ''),
  nullif(array_to_string(list_transform(list_filter(required, lambda p: not regexp_matches(draft, '(?i)' || p)),
    lambda p: 'manquant:' || p), ';'), '')), '') as check_failed
  from decided d left join specs using (doc_id)),
severed as (select *, case when check_failed = '' then 'ok' when action = 'AUTO' then 'critique'
  else 'contenu_intercepte' end as check_severity from checked)"""


def checked(spark, sf, only=None):
    """Decided messages with their draft checks; ``only`` keeps the messages it lists."""
    messages = triage_input(spark, sf)
    if only is not None:
        messages = messages.join(only.select("doc_id"), "doc_id", "left_semi")
    results = triage(messages, texts=False).select(
        "doc_id", "source", "categorie", "priorite", "confiance", "draft", "action",
        "decision_reason", "judge_verdict", "critic_score")
    return E.with_severity(E.check_drafts(results, _checks(spark, sf), "doc_id"))


@register("draft_checks", O.with_ctes(*JUDGED_CTES, _CHECKED, final="""
select doc_id, check_failed = '' as check_ok, check_failed, check_severity from severed"""))
def draft_checks(spark, sf):
    return checked(spark, sf).select("doc_id", "check_ok", "check_failed", "check_severity")


def replayed(spark, sf):
    """Decided messages with labels, draft checks, leaks and usage figures."""
    i = F.col("doc_id")
    labels = views.expected(spark, sf)
    rows = G.pii_leak(checked(spark, sf, only=labels)).withColumns({
        "tokens_in": i % 2000, "tokens_out": i % 500, "llm_calls": i % 6, "rag_hits": i % 4,
        "latency_ms": (i * 7919) % 9000})
    rows = rows.withColumn("cost_usd", G.cost_usd("tokens_in", "tokens_out"))
    return E.evaluate_rows(rows, labels, "doc_id")


REPLAYED = (
    *JUDGED_CTES, _CHECKED,
    O.mask_ctes("severed", "draft", "l"), O.EXPECTED,
    f"""replayed as materialized (select l.*, {O.entity_text("l", ("IBAN", "NIR", "CB", "TEL"))} as pii_leak,
  doc_id % 2000 as tokens_in, doc_id % 500 as tokens_out, doc_id % 6 as llm_calls, doc_id % 4 as rag_hits,
  doc_id * 7919 % 9000 as latency_ms,
  (cast(doc_id % 2000 as double) * 0.4 + cast(doc_id % 500 as double) * 1.6) / 1e6 as cost_usd,
  expected_verdict, expected_categorie, expected_priorite, expected_categorie = categorie as cat_ok,
  expected_priorite = priorite as pri_ok,
  expected_verdict = case when action = 'AUTO' then 'AUTO_SEND' else 'HITL' end as verdict_ok,
  expected_verdict = 'HITL' and action = 'AUTO' as faux_auto_send
  from l_5 l join expected using (doc_id))""",
)


@register("evaluation_rows", O.with_ctes(*REPLAYED, final="""
select doc_id, cat_ok, pri_ok, verdict_ok, faux_auto_send, decision_reason, check_severity, pii_leak,
  round(cost_usd, 9) as cost_usd, latency_ms from replayed"""))
def evaluation_rows(spark, sf):
    return replayed(spark, sf).select(
        "doc_id", "cat_ok", "pri_ok", "verdict_ok", "faux_auto_send", "decision_reason",
        "check_severity", "pii_leak", F.round("cost_usd", 9).alias("cost_usd"), "latency_ms")


def _pct(cond: str) -> str:
    return f"100.0::double * count(*) filter (where {cond}) / count(*)"


def _summary_sql(by: str) -> str:
    keys = f"{by}," if by else ""
    group = f"group by {by}" if by else ""
    part = f"partition by {by}" if by else ""
    on = f"using ({by})" if by else "on true"
    reviewed = "greatest(count(*) filter (where expected_verdict = 'HITL'), 1)"
    return f"""select s.*, p.latence_p95_ms from (select {keys} count(*) as n_emails,
  round(100.0::double * count(*) filter (where faux_auto_send) / {reviewed}, 9) as taux_faux_auto_send_pct,
  round({_pct("cat_ok")}, 9) as precision_categorie_pct, round({_pct("pri_ok")}, 9) as precision_priorite_pct,
  round({_pct("verdict_ok")}, 9) as concordance_verdict_pct,
  round({_pct("action <> 'AUTO'")}, 9) as taux_escalade_pct,
  cast(floor(avg(latency_ms)) as bigint) as latence_moyenne_ms, round(avg(cost_usd), 9) as cout_moyen_usd,
  round(sum(cost_usd), 6) as cout_total_usd, cast(floor(avg(tokens_in + tokens_out)) as bigint) as tokens_moyens,
  count(*) filter (where llm_calls = 0) as emails_zero_llm, round(avg(rag_hits), 9) as rag_hits_moyens,
  count(*) filter (where check_severity = 'critique') as brouillons_fautifs_envoyes,
  count(*) filter (where check_severity = 'contenu_intercepte') as brouillons_fautifs_interceptes,
  count(*) filter (where pii_leak <> '') as fuites_pii,
  round(100.0::double * count(*) filter (where expected_verdict = 'HITL' and judge_verdict = 'AUTO_SEND'
    and confiance >= 0.85) / {reviewed}, 9) as faux_auto_send_sans_regles_pct,
  round({_pct("judge_verdict = 'AUTO_SEND'")}, 9) as judge_auto_send_pct from replayed {group}) s
join (select {keys} cast(case when max(n) < 2 then 0 else max(case when rn = greatest(cast(floor(0.95::double * n) as bigint), 1)
    then latency_ms end) end as bigint) as latence_p95_ms from (
  select {keys} latency_ms, row_number() over ({part} order by latency_ms) as rn,
    count(*) over ({part}) as n from replayed) {group}) p {on}"""


def _rounded(df):
    floats = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({
        c: F.round(c, 6 if c == "cout_total_usd" else 9) for c in floats})


@register("evaluation_summary", O.with_ctes(*REPLAYED, final=_summary_sql("")))
def evaluation_summary(spark, sf):
    return _rounded(E.evaluate_summary(replayed(spark, sf)))


@register("evaluation_by_source", O.with_ctes(*REPLAYED, final=_summary_sql("source")))
def evaluation_by_source(spark, sf):
    return _rounded(E.evaluate_summary(replayed(spark, sf), ["source"]))


@register("evaluation_offenders", O.with_ctes(*REPLAYED, final="""
select 'faux_auto_send' as kind, doc_id as id from replayed where faux_auto_send
union all select 'brouillon_fautif_envoye', doc_id from replayed where check_severity = 'critique'
union all select 'brouillon_fautif_intercepte', doc_id from replayed where check_severity = 'contenu_intercepte'
union all select 'fuite_pii', doc_id from replayed where pii_leak <> ''"""))
def evaluation_offenders(spark, sf):
    return E.offenders(replayed(spark, sf), "doc_id")


# --- run figures -------------------------------------------------------------------------------
@register("run_figures", O.with_ctes(O.CALLS, final=f"""
select user_id % 10 as team, count(*) as n, round({_pct("action <> 'AUTO'")}, 9) as escalation_pct,
  cast(floor(avg(latency_ms)) as bigint) as latency_mean_ms,
  cast(floor(avg(tokens_in + tokens_out)) as bigint) as tokens_mean, round(avg(rag_hits), 9) as rag_hits_mean,
  count(*) filter (where llm_calls = 0) as without_model from calls group by all"""))
def run_figures(spark, sf):
    calls = views.calls(spark, sf).withColumn("team", F.col("user_id") % 10)
    return _rounded(E.run_figures(calls, ["team"]))


_AGENTS = ("guardrail", "classifier", "researcher", "drafter", "judge")
_TRACE = f"""trace as (select event_id // 5 as message, event_id as seq, {O.pick(_AGENTS, "event_id")} as agent,
  (event_id * 7919) % 9000 as duration_ms, event_type <> 'error' as success, event_type as note from events)"""


def _trace(spark, sf):
    e = F.col("event_id")
    return views.table(spark, sf, "events").select(
        F.floor(e / 5).alias("message"), e.alias("seq"), views.pick(_AGENTS, e).alias("agent"),
        ((e * 7919) % 9000).alias("duration_ms"),
        (F.col("event_type") != "error").alias("success"), F.col("event_type").alias("note"))


@register("latency_p95", O.with_ctes(O.CALLS, final="""
select latency_ms as p95_ms from (select latency_ms, row_number() over (order by latency_ms) as rn,
  count(*) over () as n from calls) where rn = cast(floor(0.95::double * n) as bigint)"""))
def latency_p95(spark, sf):
    return E.floored_rank(views.calls(spark, sf), "latency_ms", [], out="p95_ms")


@register("stage_latency", O.with_ctes(_TRACE, final="""
select t.agent, count(*) as runs, count(*) filter (where not success) as failures,
  round(avg(duration_ms), 6) as mean_ms, any_value(p.p95_ms) as p95_ms
from trace t join (select agent, duration_ms as p95_ms from (select agent, duration_ms,
  row_number() over (partition by agent order by duration_ms) as rn, count(*) over (partition by agent) as n from trace)
  where rn = cast(floor(0.95::double * n) as bigint)) p using (agent) group by t.agent"""))
def stage_latency(spark, sf):
    return E.stage_latency(_trace(spark, sf)).withColumn("mean_ms", F.round("mean_ms", 6))


@register("message_traces", O.with_ctes(_TRACE, final="""
select message, count(*) as n, string_agg(seq || ':' || agent || ':' || duration_ms || ':' || success, ' ' order by seq) as trace,
  coalesce(string_agg('[' || agent || '] ' || note, '; ' order by seq) filter (where not success), '') as errors
from trace group by message"""))
def message_traces(spark, sf):
    traced = E.message_trace(_trace(spark, sf), "message", "seq")
    step = F.transform("trace", lambda s: F.concat_ws(
        ":", s["seq"].cast("string"), s["agent"], s["duration_ms"].cast("string"),
        s["success"].cast("string")))
    return traced.select("message", F.size("trace").cast("long").alias("n"),
                         F.array_join(step, " ").alias("trace"),
                         F.array_join("errors", "; ").alias("errors"))
