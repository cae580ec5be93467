"""Registered queries: masking, rules, decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import masking as M
from ..operators import guardrail as G
from ..operators import rules as R
from . import oracle_parts as O
from . import views
from .triage import triage
from .registry import registry

QUERIES, ORACLE, register = registry()


# --- guardrail -----------------------------------------------------------------------------
@register("degenerate_messages", O.with_ctes(O.MESSAGES, final=f"""
select doc_id, length({O.strip("coalesce(email_body, '')")}) < 15 as degenerate from messages"""))
def degenerate_messages(spark, sf):
    return views.messages(spark, sf).select(
        "doc_id", G.is_degenerate("email_body").alias("degenerate"))


def _register_mask(entity: str, name: str):
    pattern, options = O.PII[entity]
    body = O.mark("email_body")
    found = f"regexp_extract_all({body}, {O.lit(pattern)}, 0, {O.lit(options)})"
    if entity == "CB":
        split = f"string_split_regex({body}, {O.lit(pattern)})"
        masked = (f"array_to_string(list_transform(range(1, len({split}) + 1), lambda k: "
                  f"{split}[k] || coalesce(case when {O.luhn(f'{found}[k]')} then "
                  f"'[CB_MASQUE]' else {found}[k] end, '')), '')")
        n = f"len(list_filter({found}, lambda c: {O.luhn('c')}))"
    else:
        masked = (f"regexp_replace({body}, {O.lit(pattern)}, '[{entity}_MASQUE]', "
                  f"{O.lit('g' + options)})")
        n = f"len({found})"

    @register(name, O.with_ctes(O.MESSAGES, final=(
        f"select doc_id, md5({O.unmark(masked)}) as masked_md5, cast({n} as bigint) as n "
        f"from messages")))
    def query(spark, sf):
        masked = M.mask_entity("email_body", entity)
        return (
            views.messages(spark, sf).select("doc_id", masked.alias("m"))
            .select("doc_id", F.md5("m.text").alias("masked_md5"),
                    F.col("m.n").cast("long").alias("n")))


for _entity, _name in (("IBAN", "mask_iban"), ("NIR", "mask_nir"), ("CB", "mask_card"),
                       ("TEL", "mask_phone"), ("EMAIL", "mask_email")):
    _register_mask(_entity, _name)


@register("mask_pii", O.with_ctes(
    O.MESSAGES, O.mask_ctes("messages", "email_body", "b"), final=f"""
select doc_id, b_text as masked, {O.entity_text("b")} as entities, 'regex' as engine from b_5"""))
def mask_pii(spark, sf):
    df = G.mask_pii(views.messages(spark, sf).select("doc_id", "email_body"), "email_body",
                    out="masked", entities="found")
    return df.select("doc_id", "masked", M.entities_text("found").alias("entities"),
                     F.lit(V.REGEX_ENGINE).alias("engine"))


@register("mask_pii_documents", O.with_ctes(
    O.mask_ctes("(select doc_id, text from documents)", "text", "b"), final=f"""
select doc_id, md5(b_text) as masked_md5, {O.entity_text("b")} as entities from b_5"""))
def mask_pii_documents(spark, sf):
    df = G.mask_pii(views.text_table(spark, sf, "documents", "doc_id").select("doc_id", "text"), "text",
                    out="masked", entities="found")
    return df.select("doc_id", F.md5("masked").alias("masked_md5"),
                     M.entities_text("found").alias("entities"))


@register("client_names", O.with_ctes(O.CASES, O.MESSAGES, final=f"""
select email_from, {O.client_name("email_from")} as client_name, count(*) as n
from (select email_from from cases union all select email_from from messages)
group by all"""))
def client_names(spark, sf):
    senders = views.cases(spark, sf).select("email_from").unionByName(
        views.messages(spark, sf).select("email_from"))
    return (senders.groupBy("email_from").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("client_name", M.client_name("email_from")))


_BODY_NAME, _BODY_N = O.mask_name("email_body", "client_name", "n")
_NAMED = f"named as (select *, {O.client_name('email_from')} as client_name from messages)"


@register("mask_client_names", O.with_ctes(O.MESSAGES, _NAMED, final=f"""
select doc_id, md5({_BODY_NAME}) as masked_md5,
  cast(case when client_name = '' then 0 else {_BODY_N} end as bigint) as n from named"""))
def mask_client_names(spark, sf):
    named = views.messages(spark, sf).select(
        "doc_id", "email_body", M.client_name("email_from").alias("client_name"))
    masked = named.select(
        "doc_id", M.mask_client_name("email_body", "client_name").alias("m"))
    return masked.select("doc_id", F.md5("m.text").alias("masked_md5"),
                         F.col("m.n").cast("long").alias("n"))


_B_TEXT, _B_N = O.mask_name("b_text", "client_name", "n")
_S_TEXT, _S_N = O.mask_name("s_text", "client_name", "n")
_F_TEXT, _ = O.mask_name("f_text", "client_name", "n")
GUARDED_CTES = (
    O.MESSAGES, _NAMED,
    O.mask_ctes("named", "email_body", "b"), O.mask_ctes("b_5", "email_subject", "s"),
    O.mask_ctes("s_5", "email_from", "f"),
    f"""guarded as materialized (select *,
  length({O.strip("coalesce(email_body, '')")}) < 15 as degenerate,
  {_B_TEXT} as body_masked, {_S_TEXT} as subject_masked, {_F_TEXT} as email_from_llm,
  case when client_name = '' then 0 else {_B_N} + {_S_N} end as n_name from f_5)""",
)
_ENTITY_COLUMNS = ", ".join(
    f"cast(case when degenerate then 0 else b_{e} + s_{e} end as bigint) as n_{e.lower()}"
    for e in V.PII_PATTERNS)
_ENTITY_SUM = " + ".join(f"b_{e} + s_{e}" for e in V.PII_PATTERNS)


def _entity_columns():
    return [F.coalesce(F.try_element_at("pii_entities", F.lit(e)), F.lit(0)).cast("long")
            .alias(f"n_{e.lower()}") for e in (*V.PII_PATTERNS, V.NAME_ENTITY)]


@register("merged_entities", O.with_ctes(*GUARDED_CTES, final=f"""
select doc_id, {_ENTITY_COLUMNS},
  cast(case when degenerate then 0 else n_name end as bigint) as n_nom,
  cast(case when degenerate then 0 else {_ENTITY_SUM} + n_name end as bigint) as pii_total
from guarded"""))
def merged_entities(spark, sf):
    df = G.mask_messages(views.messages(spark, sf))
    return df.select("doc_id", *_entity_columns(), F.col("pii_total").cast("long")
                     .alias("pii_total"))


@register("masked_messages", O.with_ctes(*GUARDED_CTES, final="""
select doc_id, email_from, email_from_llm, client_name, subject_masked,
  md5(body_masked) as body_md5, case when degenerate then 'none' else 'regex' end as pii_engine
from guarded"""))
def masked_messages(spark, sf):
    df = G.mask_messages(views.messages(spark, sf))
    return df.select("doc_id", "email_from", "email_from_llm", "client_name",
                     "subject_masked", F.md5("body_masked").alias("body_md5"), "pii_engine")


@register("reinjected_drafts", O.with_ctes(
    O.MESSAGES, O.drafted("messages"),
    f"named as (select *, {O.client_name('email_from')} as client_name from drafted)", final="""
select doc_id, case when client_name <> '' and contains(draft, '[CLIENT_NAME]')
    then '[CLIENT_NAME]=' || client_name else '' end as reinjection,
  case when client_name <> '' then replace(draft, '[CLIENT_NAME]', client_name) else draft end
    as final_text from named"""))
def reinjected_drafts(spark, sf):
    df = views.drafted(views.messages(spark, sf)).select(
        "doc_id", "draft", M.client_name("email_from").alias("client_name"))
    df = df.withColumn("map", M.reinjection_map("draft", "client_name"))
    return df.select("doc_id", M.entities_text("map").alias("reinjection"),
                     M.reinject("draft", "map").alias("final_text"))


@register("pii_leaks", O.with_ctes(
    O.MESSAGES, O.drafted("messages"),
    "replies as (select doc_id, draft || chr(10) || email_body as draft from drafted)",
    O.mask_ctes("replies", "draft", "d"), final=f"""
select doc_id, {O.entity_text("d", ("IBAN", "NIR", "CB", "TEL"))} as pii_leak from d_5"""))
def pii_leaks(spark, sf):
    """Leak check on replies that quote the whole message."""
    df = views.drafted(views.messages(spark, sf)).select(
        "doc_id", F.concat("draft", F.lit("\n"), "email_body").alias("draft"))
    return G.pii_leak(df).select("doc_id", "pii_leak")


@register("draft_excerpts", """
select doc_id, replace(case when doc_id % 3 = 0 then substr(text, 1, 1500)
  else substr(text, 1, 200) end, chr(10), ' ') as draft_excerpt from documents""")
def draft_excerpts(spark, sf):
    df = views.text_table(spark, sf, "documents", "doc_id").select(
        "doc_id", F.col("text").alias("draft"),
        F.when(F.col("doc_id") % 3 == 0, "injection").otherwise("").alias("attack_type"))
    return G.with_excerpt(df).select("doc_id", "draft_excerpt")


@register("call_costs", O.with_ctes(O.CALLS, final="""
select event_id, round((cast(tokens_in as double) * 0.4 + cast(tokens_out as double) * 1.6)
  / cast(1000000 as double), 9) as cost_usd from calls"""))
def call_costs(spark, sf):
    return views.calls(spark, sf).select(
        "event_id", F.round(G.cost_usd("tokens_in", "tokens_out"), 9).alias("cost_usd"))


def _census_sql(source: str, text: str, by: str) -> str:
    parts = " union all ".join(
        f"select {by}, '{e}' as entity, count(*) as messages, cast(sum(m_{e}) as bigint) as found "
        f"from m_5 where m_{e} > 0 group by {by}" for e in V.PII_PATTERNS)
    return O.with_ctes(O.mask_ctes(source, text, "m"), final=parts)


@register("pii_census_documents", _census_sql(
    "(select source, lang, text from documents)", "text", "source, lang"))
def pii_census_documents(spark, sf):
    return G.pii_census(views.text_table(spark, sf, "documents", "doc_id"), "text", ["source", "lang"])


@register("pii_census_pages", _census_sql(
    "(select split_part(url, '/', 3) as host, html from pages)", "html", "host"))
def pii_census_pages(spark, sf):
    df = views.text_table(spark, sf, "pages", "page_id").select(
        F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), "html")
    return G.pii_census(df, "html", ["host"])


# --- rules -----------------------------------------------------------------------------------
_TEXT = "coalesce(email_subject, '') || chr(10) || coalesce(email_body, '')"


def _subject_and_body():
    return F.concat(F.coalesce("email_subject", F.lit("")), F.lit("\n"),
                    F.coalesce("email_body", F.lit("")))


def _register_input_rule(label: str):
    @register(f"rule_{label}", O.with_ctes(O.MESSAGES, final=(
        f"select doc_id, {O.has(_TEXT, O.INPUT[label])} as hit from messages")))
    def query(spark, sf):
        df = views.messages(spark, sf).select("doc_id", _subject_and_body().alias("t"))
        return df.select("doc_id", R.matches_input_rule("t", label).alias("hit"))


for _label in O.INPUT:
    _register_input_rule(_label)


@register("rule_expediteur_automatique", O.with_ctes(O.MESSAGES, final=f"""
select doc_id, {O.has("coalesce(email_from, '')", O.AUTO_ADDRESS)} or {O.has(_TEXT, O.AUTO_TEXT)}
  as hit from messages"""))
def rule_expediteur_automatique(spark, sf):
    df = views.messages(spark, sf).select("doc_id", "email_from", _subject_and_body().alias("t"))
    return df.select("doc_id", R.is_automatic_sender("email_from", "t").alias("hit"))


_SENSITIVE = "concat_ws('/', " + ", ".join(
    f"case when b_{e} + s_{e} > 0 and not degenerate then '{e}' end"
    for e in V.SENSITIVE_ENTITIES) + ")"


@register("rule_pii_sensible", O.with_ctes(*GUARDED_CTES, final=f"""
select doc_id, case when {_SENSITIVE} <> '' then 'pii_sensible:' || {_SENSITIVE} else '' end
  as label from guarded"""))
def rule_pii_sensible(spark, sf):
    df = G.mask_messages(views.messages(spark, sf))
    return df.select("doc_id", F.coalesce(R.sensitive_pii("pii_entities"), F.lit(""))
                     .alias("label"))


# Bodies are long; the sample line alone gives the short ones.
_SHORT = f"""short as (select doc_id, case when doc_id % 2 = 0 then email_body
  else {O.pick(views.S.SNIPPETS, "doc_id // 2")} end as body from messages)"""


@register("rule_piece_jointe_sans_contexte", O.with_ctes(O.MESSAGES, _SHORT, final=f"""
select doc_id, length({O.strip("body")}) <= 120 and {O.has(O.strip("body"), O.ATTACHMENT)} as hit
from short"""))
def rule_piece_jointe_sans_contexte(spark, sf):
    i = F.col("doc_id")
    body = F.when(i % 2 == 0, F.col("email_body")).otherwise(
        views.pick(views.S.SNIPPETS, F.floor(i / 2)))
    return views.messages(spark, sf).select(
        "doc_id", R.is_bare_attachment(body).alias("hit"))


HIT_CTES = (*GUARDED_CTES, f"""hits as materialized (select *, concat_ws('+',
  {O.input_hits(_TEXT, "email_from")}, {O.structural(_SENSITIVE, "email_body")}) as rules
  from guarded)""")


@register("input_rule_hits", O.with_ctes(
    *HIT_CTES, final="select doc_id, rules from hits"))
def input_rule_hits(spark, sf):
    df = R.with_input_hits(G.mask_messages(views.messages(spark, sf)))
    return df.select("doc_id", F.array_join("input_hits", "+").alias("rules"))


@register("deterministic_report", O.with_ctes(*HIT_CTES, final="""
select doc_id, subject_masked, md5(body_masked) as body_md5, client_name, degenerate,
  case when degenerate then '' else rules end as rules from hits"""))
def deterministic_report(spark, sf):
    df = R.deterministic_report(views.messages(spark, sf))
    return df.select("doc_id", "subject_masked", F.md5("body_masked").alias("body_md5"),
                     "client_name", "degenerate", F.array_join("rules", "+").alias("rules"))


def _reasons_cte() -> str:
    rows = [(label, why) for label, _, why in V.INPUT_RULES]
    rows += [*V.STRUCTURAL_REASONS, *[(label, why) for label, _, why in V.OUTPUT_RULES]]
    values = ", ".join(f"({O.lit(a)}, {O.lit(b)})" for a, b in rows)
    return f"reasons as (select * from (values {values}) as r(code, why))"


@register("rule_justifications", O.with_ctes(*HIT_CTES, _reasons_cte(), final="""
select doc_id, rule, coalesce(why, '') as why from (
  select doc_id, unnest(string_split(rules, '+')) as rule from hits
  where rules <> '' and not degenerate) left join reasons on code = split_part(rule, ':', 1)"""))
def rule_justifications(spark, sf):
    report = R.deterministic_report(views.messages(spark, sf))
    return R.report_reasons(report, ["doc_id"]).select("doc_id", "rule", "why")


def _register_output_rule(label: str):
    text = "draft || chr(10) || email_body"

    @register(f"output_rule_{label}", O.with_ctes(
        O.MESSAGES, O.drafted("messages"),
        final=f"select doc_id, {O.has(text, O.OUTPUT[label])} as hit from drafted"))
    def query(spark, sf):
        df = views.drafted(views.messages(spark, sf)).select(
            "doc_id", F.concat("draft", F.lit("\n"), "email_body").alias("t"))
        return df.select("doc_id", R.matches_output_rule("t", label).alias("hit"))


for _label in O.OUTPUT:
    _register_output_rule(_label)


@register("external_links_in_pages",
          f"select page_id, {O.has('html', O.OUTPUT['lien_externe'])} as hit from pages")
def external_links_in_pages(spark, sf):
    return views.text_table(spark, sf, "pages", "page_id").select(
        "page_id", R.matches_output_rule("html", "lien_externe").alias("hit"))


@register("output_rule_hits", O.with_ctes(O.MESSAGES, O.drafted("messages"), final=f"""
select doc_id, concat_ws('+', {O.output_hits("draft")}) as rules from drafted"""))
def output_rule_hits(spark, sf):
    df = views.drafted(views.messages(spark, sf)).select("doc_id", "draft")
    return df.select("doc_id", F.array_join(R.check_draft_output("draft"), "+").alias("rules"))


_FORCED = ", ".join(O.lit(c) for c in V.POLICY_DEFAULTS["hitl_force_categories"].split(","))


@register("forced_by_class", O.with_ctes(O.MESSAGES, O.classified("messages"), final=f"""
select doc_id, case when categorie in ({_FORCED}) then 'rules_table:' || categorie else '' end as by_category,
  case when priorite = 'haute' then 'priorite:haute' else '' end as by_priority from classified"""))
def forced_by_class(spark, sf):
    from ..operators.policy import policy_fields
    p = policy_fields()
    df = views.classified(views.messages(spark, sf))
    return df.select(
        "doc_id",
        F.coalesce(R.forced_category("categorie", p["hitl_force_categories"]), F.lit(""))
        .alias("by_category"),
        F.coalesce(R.forced_priority("priorite", p["hitl_force_priorities"]), F.lit(""))
        .alias("by_priority"))


def triage_input(spark, sf):
    return views.judged(views.drafted(views.classified(views.messages(spark, sf))))


JUDGED_CTES = (
    *HIT_CTES, O.classified("hits", "c0"), O.drafted("c0", "c1"), O.judged("c1", "c2"),
    """c3 as (select * exclude (categorie, priorite, confiance, draft, judge_verdict),
  case when degenerate then 'autre' else categorie end as categorie,
  case when degenerate then 'normale' else priorite end as priorite,
  case when degenerate then 0.0 else confiance end as confiance,
  case when degenerate then '' else draft end as draft,
  case when degenerate then 'HUMAN_REVIEW' else judge_verdict end as judge_verdict,
  cast(pertinence + ton + conformite + factualite as double) / 20 as raw_score,
  judge_verdict = 'AUTO_SEND' and trim(draft) <> '' and
    cast(pertinence + ton + conformite + factualite as double) / 20 >= 0.75 as critic_approved
  from c2)""",
    f"""forced as (select *, case when degenerate then 'degenerate_input'
  when categorie in ({_FORCED}) then 'rules_table:' || categorie
  when priorite = 'haute' then 'priorite:haute'
  when rules <> '' then 'sensitive:' || rules
  when concat_ws('+', {O.output_hits("draft")}) <> ''
    then 'output_guardrail:' || concat_ws('+', {O.output_hits("draft")})
  when judge_verdict = 'REJECT' then 'judge_reject' end as forced_reason from c3)""",
    """decided as materialized (select *, case when forced_reason is not null then 'HITL'
    when confiance >= 0.85 and critic_approved then 'AUTO'
    when confiance >= 0.70 then 'HITL' else 'MANUAL' end as action,
  coalesce(forced_reason, 'seuils') as decision_reason from forced)""",
)


@register("rule_evaluation", O.with_ctes(*JUDGED_CTES, final="""
select doc_id, coalesce(forced_reason, '') as forced_reason from decided"""))
def rule_evaluation(spark, sf):
    df = triage(triage_input(spark, sf))
    return R.evaluate(df).select(
        "doc_id", F.coalesce("forced_reason", F.lit("")).alias("forced_reason"))


@register("triage_decisions", O.with_ctes(*JUDGED_CTES, final="""
select doc_id, message_id, categorie, priorite, action, action <> 'AUTO' as requires_human,
  decision_reason from decided"""))
def triage_decisions(spark, sf):
    return triage(triage_input(spark, sf), texts=False).select(
        "doc_id", "message_id", "categorie", "priorite", "action", "requires_human",
        "decision_reason")


@register("escalation_reasons", O.with_ctes(*JUDGED_CTES, final="""
select decision_reason, count(*) as n from decided where action <> 'AUTO' group by all"""))
def escalation_reasons(spark, sf):
    """Why would messages be escalated? Most frequent reason first."""
    return (
        triage(triage_input(spark, sf), texts=False).where("requires_human")
        .groupBy("decision_reason").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "decision_reason"))


@register("judge_rejections", O.with_ctes(
    O.MESSAGES, O.drafted("messages"), O.judged("drafted"),
    final="""select doc_id, case when judge_verdict = 'REJECT' then 'judge_reject' else '' end as forced_reason
from judged"""))
def judge_rejections(spark, sf):
    """The rule table on messages where only the verdict can speak."""
    none = F.array().cast("array<string>")
    df = views.judged(views.drafted(views.messages(spark, sf))).withColumns({
        "degenerate": F.lit(False), "categorie": F.lit("demande"), "priorite": F.lit("normale"),
        "input_hits": none, "output_hits": none})
    return R.evaluate(df).select(
        "doc_id", F.coalesce("forced_reason", F.lit("")).alias("forced_reason"))


@register("rule_census", O.with_ctes(*HIT_CTES, final="""
select source, rule, count(*) as messages from (
  select source, unnest(string_split(rules, '+')) as rule from hits where rules <> '')
group by all"""))
def rule_census(spark, sf):
    df = R.with_input_hits(G.mask_messages(views.messages(spark, sf)))
    return R.rule_census(df, ["source"])


_LABELS = ", ".join(f"({O.lit(a)}, {O.lit(b)})" for a, b in V.REASON_LABELS)


@register("reason_labels", O.with_ctes(O.CASES, _reasons_cte(), final=f"""
select case_id, decision_reason, l.label as escalation_label, coalesce(why, '') as escalation_why
from cases join (values {_LABELS}) as l(base, label) on base = split_part(decision_reason, ':', 1)
left join reasons on code = split_part(split_part(
  case when contains(decision_reason, ':') then split_part(decision_reason, ':', 2)
  else decision_reason end, '+', 1), ':', 1)"""))
def reason_labels(spark, sf):
    return R.with_reason_label(views.cases(spark, sf)).select(
        "case_id", "decision_reason", "escalation_label", "escalation_why")
