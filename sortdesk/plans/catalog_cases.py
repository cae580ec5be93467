"""Registered queries: review cases, audit, policy history, admission."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions import masking as M
from ..operators import admission, audit, cases as C, policy as P
from ..session import cut_lineage, written
from ..sources.templates import latest_templates, template_catalogue
from . import oracle_parts as O
from . import sample_values as S
from . import views
from .catalog_guardrail import JUDGED_CTES, _reasons_cte, triage_input
from .triage import triage
from .registry import registry

QUERIES, ORACLE, register = registry()


# The output rules on the fixed reply lines: two checks against plain text suffice there.
def _hits(text: str) -> str:
    return f"concat_ws('+', {O.output_hits(text)})"


# Accepted texts in command order; the draft in force is the last one before a command.
DECISION_CTES = (
    O.CASES, O.COMMANDS,
    f"""own as (select *, command in ('validated', 'edited') and final_draft <> '' as own_text,
  command in ('validated', 'edited') as approving,
  case when command in ('validated', 'edited') and final_draft <> '' then {_hits("final_draft")} else '' end as own_hits
  from commands)""",
    """carried as (select *, last_value(case when own_text and trim(final_draft) <> '' and own_hits = ''
    then final_draft end ignore nulls) over (partition by case_id order by seq
    rows between unbounded preceding and 1 preceding) as in_force from own)""",
    f"""resolved as (select k.*, c.case_id is not null as known,
  case when own_text then final_draft when approving then coalesce(in_force, c.draft, '') else '' end as text_used,
  case when own_text then own_hits when approving and in_force is null
    then {_hits("coalesce(c.draft, '')")} else '' end as hits
  from carried k left join cases c on k.case_id = c.case_id)""",
    """judged_cmds as materialized (select *, case
  when command not in ('validated', 'edited', 'rejected') then 'unknown_decision'
  when not known then 'unknown_case'
  when command = 'edited' and trim(final_draft) = '' then 'text_required'
  when hits <> '' then 'output_guardrail:' || hits end as refusal from resolved
  where command <> 'mark_sent')""",
    """decisions as (select seq, case_id, "at" as decided_at, decided_by, command as decision,
  text_used as final_draft, comment from judged_cmds where refusal is null)""",
    """sent as (select case_id, min("at") as sent_at, arg_min(decided_by, seq) as sent_by from commands
  where command = 'mark_sent' and case_id in (select case_id from cases) group by case_id)""",
    """state as materialized (select c.*, coalesce(n_decisions, 0) as n_decisions, last_decision,
  last_decided_by, sent_at, sent_by, coalesce(final_text, draft) as final_draft,
  case when sent_at is not null then 'sent' else coalesce(last_decision, 'pending') end as status
  from cases c left join (select case_id, count(*) as n_decisions,
    arg_max(decision, seq) as last_decision, arg_max(decided_by, seq) as last_decided_by,
    arg_max(final_draft, seq) filter (where decision in ('validated', 'edited') and trim(final_draft) <> '') as final_text
    from decisions group by case_id) d using (case_id)
  left join sent using (case_id))""",
)


def decided(spark, sf):
    return C.apply_decisions(views.commands(spark, sf), views.cases(spark, sf))


def sends(spark, sf):
    return C.apply_sends(views.commands(spark, sf), views.cases(spark, sf))[0]


def state(spark, sf, decisions=None):
    taken = decisions if decisions is not None else decided(spark, sf)[0]
    return C.case_state(views.cases(spark, sf), taken, sends(spark, sf))


@register("accepted_decisions", O.with_ctes(*DECISION_CTES, final="select * from decisions"))
def accepted_decisions(spark, sf):
    return decided(spark, sf)[0]


@register("refused_decisions", O.with_ctes(*DECISION_CTES, final="""
select seq, case_id, command, refusal from judged_cmds where refusal is not null"""))
def refused_decisions(spark, sf):
    return decided(spark, sf)[1].select("seq", "case_id", "command", "refusal")


@register("decision_history", O.with_ctes(*DECISION_CTES, final="""
select case_id, seq, decision, decided_by, comment from decisions"""))
def decision_history(spark, sf):
    return C.history(decided(spark, sf)[0]).select(
        "case_id", "seq", "decision", "decided_by", "comment")


@register("case_states", O.with_ctes(*DECISION_CTES, final="""
select case_id, status, final_draft, n_decisions, coalesce(last_decision, '') as last_decision,
  coalesce(last_decided_by, '') as last_decided_by, coalesce(sent_by, '') as sent_by from state"""))
def case_states(spark, sf):
    blank = F.lit("")
    return state(spark, sf).select(
        "case_id", "status", "final_draft", "n_decisions",
        *[F.coalesce(c, blank).alias(c)
          for c in ("last_decision", "last_decided_by", "sent_by")])


@register("case_states_in_parts", ORACLE["case_states"])
def case_states_in_parts(spark, sf):
    """The same from a stored fold that three parts of the command log were added to."""
    commands, cases = views.commands(spark, sf), views.cases(spark, sf)
    low, high = commands.agg(F.min("seq"), F.max("seq")).first()
    cuts = [low + (high - low + 1) * i // 3 for i in range(4)]
    fold = C.decision_fold(C.apply_decisions(commands.limit(0), cases)[0])
    for a, b in zip(cuts, cuts[1:]):
        part = commands.where((F.col("seq") >= a) & (F.col("seq") < b))
        fold = written(C.advance(part, cases, fold)[0], "case-folds")
    blank = F.lit("")
    return C.folded_state(cases, fold, sends(spark, sf)).select(
        "case_id", "status", "final_draft", "n_decisions",
        *[F.coalesce(c, blank).alias(c)
          for c in ("last_decision", "last_decided_by", "sent_by")])


@register("send_outcomes", O.with_ctes(O.CASES, O.COMMANDS, final="""
select seq, case_id, case when case_id not in (select case_id from cases) then 'not_found'
  when seq = min(seq) over (partition by case_id) then 'marked_sent' else 'already_sent' end as result
from commands where command = 'mark_sent'"""))
def send_outcomes(spark, sf):
    return C.apply_sends(views.commands(spark, sf), views.cases(spark, sf))[1]


_NAME = O.client_name("email_from")


@register("ready_to_send", O.with_ctes(*DECISION_CTES, final=f"""
select case_id, message_id, email_from as email_to, subject_raw as subject, final_draft, status,
  case when {_NAME} <> '' and contains(final_draft, '[CLIENT_NAME]')
    then '[CLIENT_NAME]=' || {_NAME} else '' end as reinjection
from state where status in ('validated', 'edited') and sent_at is null
order by case_id limit 200"""))
def ready_to_send(spark, sf):
    return C.ready_to_send(state(spark, sf), 200).select(
        "case_id", "message_id", "email_to", "subject", "final_draft", "status",
        M.entities_text("pii_reinjection").alias("reinjection"))


_LABELS = ", ".join(f"({O.lit(a)}, {O.lit(b)})" for a, b in V.REASON_LABELS)
_VIEW = f"""select case_id, created_at as received_at, email_from,
  case when subject_masked <> '' then subject_masked else subject_raw end as subject,
  categorie, priorite, confiance, decision_reason as escalation_code, l.label as escalation_label,
  coalesce(why, '') as escalation_why, status {{extra}}
from {{src}} join (values {_LABELS}) as l(base, label) on base = split_part(decision_reason, ':', 1)
left join reasons on code = split_part(case when contains(decision_reason, ':')
  then split_part(decision_reason, ':', 2) else decision_reason end, '+', 1)"""


@register("queue_view", O.with_ctes(
    *DECISION_CTES, _reasons_cte(), final=_VIEW.format(extra="", src="state")))
def queue_view(spark, sf):
    return C.queue_view(state(spark, sf))


@register("case_detail", O.with_ctes(*DECISION_CTES, _reasons_cte(), final=f"""
select v.*, d.seq, d.decided_by as decided_by, d.decision, d.final_draft as decision_draft, d.comment
from ({_VIEW.format(src="state", extra=""", subject_masked, final_draft as draft, draft as draft_original,
  n_decisions, last_decision, body_masked, judge_scores, contexts""")}) v left join decisions d using (case_id)"""
    .replace("from state join", """from (select *, subject_masked || ' | ' || draft as body_masked,
    'pertinence=' || (1 + case_id % 5) || ';ton=' || (1 + case_id * 2 % 5) as judge_scores,
    '[' || categorie || '] ' || draft as contexts from state) state join""")))
def case_detail(spark, sf):
    """Cases with scores, contexts and masked body, once for each decision."""
    i = F.col("case_id")
    taken = cut_lineage(decided(spark, sf)[0])
    cases = state(spark, sf, taken).withColumns({
        "body_masked": F.concat_ws(" | ", "subject_masked", "draft"),
        "judge_scores": F.create_map(F.lit("pertinence"), 1 + i % 5, F.lit("ton"), 1 + i * 2 % 5),
        "contexts": F.array(F.concat(F.lit("["), "categorie", F.lit("] "), "draft"))})
    scores = F.concat(F.lit("pertinence="), F.col("judge_scores")["pertinence"].cast("string"),
                      F.lit(";ton="), F.col("judge_scores")["ton"].cast("string"))
    return C.case_detail(cases, decisions=taken).withColumns({
        "judge_scores": scores, "contexts": F.array_join("contexts", "\n")}).drop("decided_at")


@register("review_queue", """
select o_orderkey as case_id, o_orderdate as created_at, o_orderstatus as status
from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 200""")
def review_queue(spark, sf):
    df = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.col("o_orderstatus").alias("status"))
    return C.review_queue(df, 200, status="O")


@register("cases_selected", O.with_ctes(*DECISION_CTES, final="""
select case_id, status, categorie from state where status = 'pending' and categorie = 'spam'
  and case_id in (select o_custkey from orders)"""))
def cases_selected(spark, sf):
    ids = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"))
    return C.filter_cases(state(spark, sf), "pending", "spam", ids).select(
        "case_id", "status", "categorie")


@register("decision_journal", O.with_ctes(*DECISION_CTES, final="""
select case_id, seq, categorie, decision_reason, decision, decided_by as agent,
  strftime(decided_at, '%Y-%m-%d %H:%M') as decided_minute, comment
from decisions join cases using (case_id)"""))
def decision_journal(spark, sf):
    return C.journal(views.cases(spark, sf), decided(spark, sf)[0])


@register("human_decisions_on_metrics", O.with_ctes(*DECISION_CTES, O.CALLS, final="""
select event_id, action, coalesce(last_decision, '') as human_decision
from calls left join state on user_id = case_id"""))
def human_decisions_on_metrics(spark, sf):
    return C.human_decisions_on(
        views.calls(spark, sf), decided(spark, sf)[0], "user_id").select(
        "event_id", "action", "human_decision")


_KEY = "coalesce(message_id, job_id)"


@register("enqueued_cases", O.with_ctes(*JUDGED_CTES, final=f"""
select doc_id, case_key, decision_reason from (
  select *, {_KEY} as case_key, row_number() over (partition by {_KEY} order by received_at, doc_id) as rn
  from decided where action <> 'AUTO') where case_key is null or rn = 1"""))
def enqueued_cases(spark, sf):
    results = triage(triage_input(spark, sf), texts=False).select(
        "doc_id", "message_id", "job_id", "received_at", "requires_human", "decision_reason")
    return C.enqueue(results, order=("received_at", "doc_id")).select(
        "doc_id", "case_key", "decision_reason")


# --- counts and exports ----------------------------------------------------------------------
@register("cases_by_status", O.with_ctes(*DECISION_CTES, final="""
select status, count(*) as n from state group by status"""))
def cases_by_status(spark, sf):
    return audit.cases_by_status(state(spark, sf))


@register("cases_by_reason", O.with_ctes(O.CASES, final="""
select decision_reason, count(*) as n from cases group by all order by n desc, decision_reason"""))
def cases_by_reason(spark, sf):
    return audit.cases_by_reason(views.cases(spark, sf))


@register("reason_shares", O.with_ctes(O.CASES, final="""
select decision_reason, count(*) as n, cast(count(*) as double) / max(count(*)) over () as share
from cases group by decision_reason"""))
def reason_shares(spark, sf):
    return audit.reason_shares(views.cases(spark, sf))


@register("reason_families", O.with_ctes(O.CASES, final="""
select split_part(decision_reason, ':', 1) as family, count(*) as n from cases group by all"""))
def reason_families(spark, sf):
    return audit.reason_families(views.cases(spark, sf))


@register("decision_totals", O.with_ctes(*DECISION_CTES, final="""
select cast(sum(n_decisions) as bigint) as total_decisions, count(*) filter (where status = 'pending') as pending,
  count(*) filter (where status in ('validated', 'edited', 'rejected')) as processed from state"""))
def decision_totals(spark, sf):
    return audit.decision_totals(state(spark, sf))


@register("action_tally", O.with_ctes(O.CALLS, final="""
select count(*) filter (where action = 'AUTO') as n_auto, count(*) filter (where action = 'HITL') as n_hitl,
  count(*) filter (where action = 'MANUAL') as n_manual,
  count(*) filter (where action <> 'AUTO') as escalated from calls"""))
def action_tally(spark, sf):
    return audit.action_tally(views.calls(spark, sf))


@register("audit_export", O.with_ctes(*DECISION_CTES, final="""
select case_id, created_at, s.message_id, s.categorie, s.priorite, s.confiance, s.decision_reason, s.status,
  d.decided_at, d.decided_by, d.decision, d.comment
from state s left join decisions d using (case_id)"""))
def audit_export(spark, sf):
    log = cut_lineage(decided(spark, sf)[0])  # read three times, like the log on disk
    return audit.audit_export(state(spark, sf, log), log).drop(
        "action", "judge_verdict", "cost_usd", "duration_ms")


@register("export_intruders", O.with_ctes(O.CASES, final="""
select distinct email_from from cases where lower(trim(email_from)) not in (
  select lower(trim('"Customer#' || lpad(cast(s_suppkey as varchar), 9, '0') || '" <'
    || lower(c_mktsegment) || '.' || s_suppkey || '@exemple.fr>'))
  from supplier join customer on c_custkey = s_suppkey)"""))
def export_intruders(spark, sf):
    """Senders that are no supplier: the allow-list holds one address per supplier."""
    key = F.col("s_suppkey").cast("string")
    allowed = (
        views.table(spark, sf, "supplier")
        .join(views.table(spark, sf, "customer"), F.col("c_custkey") == F.col("s_suppkey"))
        .select(F.concat(
            F.lit('  "CUSTOMER#'), F.lpad(key, 9, "0"), F.lit('" <'), F.lower("c_mktsegment"),
            F.lit("."), key, F.lit("@exemple.fr> ")).alias("email_from")))
    return audit.export_gate(views.cases(spark, sf), allowed)


@register("aligned_orders", """
select o_orderkey as case_id, o_orderstatus as status, o_totalprice as amount,
  cast(null as varchar) as sent_by from orders
union all
select 1000000000 + c_custkey, cast(null as varchar), c_acctbal, cast(null as varchar)
from customer where 1000000000 + c_custkey not in (select o_orderkey from orders)""")
def aligned_orders(spark, sf):
    """Orders narrowed and widened to a contract, plus rows of an older table."""
    contract = T.StructType([
        T.StructField("case_id", T.LongType()), T.StructField("status", T.StringType()),
        T.StructField("amount", T.DoubleType()), T.StructField("sent_by", T.StringType())])
    current = audit.align_schema(
        views.table(spark, sf, "orders").withColumnsRenamed(
            {"o_orderkey": "case_id", "o_orderstatus": "status", "o_totalprice": "amount"}),
        contract)
    older = views.table(spark, sf, "customer").select(
        (F.col("c_custkey") + 1000000000).alias("case_id"), F.col("c_acctbal").alias("amount"),
        F.col("c_name").alias("dropped"))
    return audit.load_versions(current, older, key="case_id")


# --- policy ------------------------------------------------------------------------------------

def policies(spark, sf):
    return P.policy_rows(views.policy_log(spark, sf))


@register("policy_rows", O.with_ctes(O.POLICY_LOG, final="""
select valid_from, updated_by, seuil_auto, seuil_hitl, categories, priorities, sensitive_on,
  cast(0.75 as double) as approve_at, seuil_hitl <= seuil_auto as accepted from policy_log"""))
def policy_rows(spark, sf):
    ok, refused = policies(spark, sf)
    both = ok.withColumn("accepted", F.lit(True)).unionByName(
        refused.withColumn("accepted", F.lit(False)))
    return both.select(
        "valid_from", "updated_by", "seuil_auto", "seuil_hitl",
        F.array_join("hitl_force_categories", "|").alias("categories"),
        F.array_join("hitl_force_priorities", "|").alias("priorities"),
        F.col("sensitive_rules_enabled").alias("sensitive_on"),
        F.col("critic_approve_threshold").alias("approve_at"), "accepted")


@register("policy_as_of", O.with_ctes(O.POLICY_LOG, O.CALLS, final="""
select event_id, ts, coalesce(seuil_auto, 0.85) as seuil_auto, coalesce(seuil_hitl, 0.7) as seuil_hitl,
  coalesce(categories, '') as categories
from calls asof left join policies on calls.ts >= policies.valid_from"""))
def policy_as_of(spark, sf):
    ok, _ = policies(spark, sf)
    facts = views.calls(spark, sf).select("event_id", "ts")
    joined = P.as_of(facts, "ts", ok, ["seuil_auto", "seuil_hitl", "hitl_force_categories"])
    p = F.col("policy")
    return joined.select(
        "event_id", "ts", F.coalesce(p["seuil_auto"], F.lit(0.85)).alias("seuil_auto"),
        F.coalesce(p["seuil_hitl"], F.lit(0.7)).alias("seuil_hitl"),
        F.coalesce(F.array_join(p["hitl_force_categories"], "|"), F.lit(""))
        .alias("categories"))


@register("decisions_under_policy_history", O.with_ctes(O.POLICY_LOG, O.CALLS, final="""
select event_id, case when contains('|' || coalesce(categories, '') || '|', '|' || categorie || '|')
    then 'rules_table:' || categorie
  when priorite = 'haute' then 'priorite:haute' else 'seuils' end as decision_reason,
  case when contains('|' || coalesce(categories, '') || '|', '|' || categorie || '|') or priorite = 'haute' then 'HITL'
    when confiance >= seuil_auto then 'AUTO' when confiance >= seuil_hitl then 'HITL' else 'MANUAL' end as action
from (select event_id, categorie, priorite, confiance, coalesce(seuil_auto, 0.85) as seuil_auto,
  coalesce(seuil_hitl, 0.7) as seuil_hitl,
  coalesce(categories, 'reclamation|resiliation|donnees_personnelles|spam|autre') as categories
from (select event_id, ts, """ + O.pick(S.CATEGORY_CYCLE, "event_id") + " as categorie, "
    + O.pick(S.PRIORITY_CYCLE, "event_id // 9") + """ as priorite,
  cast((event_id * 37) % 101 as double) / 100 as confiance from calls) f
asof left join policies on f.ts >= policies.valid_from)"""))
def decisions_under_policy_history(spark, sf):
    """Decide every past call again with the policy that was in force at its time."""
    from ..operators.rules import decide
    ok, _ = policies(spark, sf)
    e = F.col("event_id")
    none = F.array().cast("array<string>")
    facts = views.calls(spark, sf).select(
        "event_id", "ts", views.pick(S.CATEGORY_CYCLE, e).alias("categorie"),
        views.pick(S.PRIORITY_CYCLE, F.floor(e / 9)).alias("priorite"),
        ((e * 37) % 101).cast("double").alias("pct"))
    known = P.as_of(facts, "ts", ok, list(P.TUNABLES))
    values = F.struct(*[F.col("policy")[f].alias(f) for f in P.TUNABLES])
    facts = known.withColumn("policy", F.when(F.col("policy").isNull(), P.policy_struct())
                             .otherwise(values))
    facts = facts.select(
        "event_id", "categorie", "priorite", (F.col("pct") / 100).alias("confiance"), "policy",
        F.lit(False).alias("degenerate"), none.alias("input_hits"),
        none.alias("output_hits"), F.lit("AUTO_SEND").alias("judge_verdict"),
        F.lit(True).alias("critic_approved"))
    return decide(facts, F.col("policy")).select("event_id", "decision_reason", "action")


# --- templates ---------------------------------------------------------------------------------
_FILES = """files as (select lower(replace(p_type, ' ', '_')) as name, p_size as maj, p_partkey as min,
  p_size || '.' || p_partkey as version, p_name as content from part),
pins as (select name, min(version) as version from files where maj = 7 group by name)"""


@register("latest_templates", O.with_ctes(_FILES, final="""
select name, arg_max(version, cast(maj as bigint) * 1000000000 + min) as version, arg_max(content, cast(maj as bigint) * 1000000000 + min) as content
from files where name not in (select name from pins) group by name
union all select name, version, content from files join pins using (name, version)"""))
def latest_templates_query(spark, sf):
    part = views.table(spark, sf, "part")
    version = F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    name = F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("_")))
    files = part.select(F.concat(name, F.lit("_v"), version, F.lit(".txt")).alias("file_name"),
                        F.col("p_name").alias("content"))
    pins = part.where("p_size = 7").groupBy(name.alias("name")).agg(
        F.min(version).alias("version"))
    return latest_templates(template_catalogue(files), pins)[0]


# --- admission ---------------------------------------------------------------------------------
_TTL = """walk as (
  select event_id, ts, request_key, row_number() over (partition by request_key order by ts, event_id) as rn
  from requests where request_key is not null),
fold as (
  select *, ts as anchor_ts, event_id as anchor_id from walk where rn = 1
  union all
  select w.event_id, w.ts, w.request_key, w.rn,
    case when w.ts - f.anchor_ts <= interval 3600 second then f.anchor_ts else w.ts end,
    case when w.ts - f.anchor_ts <= interval 3600 second then f.anchor_id else w.event_id end
  from fold f join walk w on w.request_key = f.request_key and w.rn = f.rn + 1)"""


@register("dedupe_ttl", "with recursive " + O.REQUESTS + ",\n" + _TTL + """
select event_id, anchor_id, event_id <> anchor_id as duplicate from fold
union all select event_id, event_id, false from requests where request_key is null""")
def dedupe_ttl(spark, sf):
    return admission.dedupe_ttl(views.requests(spark, sf).drop("body")).select(
        "event_id", "anchor_id", "duplicate")


@register("admitted_requests", O.with_ctes(
    O.REQUESTS, """unfit as (select *, cast(ts as date) as d, case when length(trim(body)) < 15 then 'too_short'
  when length(body) > 2000 then 'too_long' end as u from requests)""",
    """sess as (select *, count(*) filter (where succeeded) over (partition by session_id, d
  order by ts, event_id rows between unbounded preceding and 1 preceding) as done_before
  from unfit where u is null)""",
    """ranked as (select *, row_number() over (partition by d order by ts, event_id) as day_rank
  from sess where done_before < 3)""",
    """ends as (select d, max(ts) as day_end from ranked where day_rank <= 200 group by d having count(*) = 200)""",
    """counted as (select s.*, ends.day_end, count(*) filter (where succeeded and (day_end is null or ts <= day_end))
    over (partition by session_id, d order by ts, event_id rows between unbounded preceding and 1 preceding) as used
  from sess s left join ends using (d))""", final="""
select event_id, u as refusal from unfit where u is not null
union all select event_id, case when used >= 3 then 'session' when day_end is not null and ts > day_end
  then 'day' else 'admitted' end from counted"""))
def admitted_requests(spark, sf):
    return admission.admit(views.requests(spark, sf)).select(
        "event_id", F.coalesce("refusal", F.lit("admitted")).alias("refusal"))


@register("retained_sessions", """
select event_id, user_id from events where ts >= (select max(ts) from events) - interval 12 hour""")
def retained_sessions(spark, sf):
    events = views.table(spark, sf, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    now = events.agg(F.max("ts")).first()[0]
    return admission.expire(events, F.lit(now).cast("timestamp_ntz")).select(
        "event_id", "user_id")
