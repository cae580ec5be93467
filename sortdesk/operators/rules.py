"""The deterministic rule table and the decision that follows from it.

A pattern with Unicode boundaries scans a text at roughly 10 MB/s per core, a plain
substring search is more than ten times faster. So each rule carries the substrings one
of which any match must contain; the pattern itself only runs on texts that hold one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.once import evaluate_once
from ..functions.text import (LABEL_SEPARATOR, ci, col, has_odd_case_sql, labels, sql_text,
                              strip, text_or_empty)
from .guardrail import mask_messages
from .policy import Policy, policy_fields

# rule label -> groups of lower-case substrings; a match needs one of every group.
_NEEDED = {
    "changement_coordonnees_bancaires": (
        ("chang", "nouveau", "nouvelle", "modifi", "mettre", "remplac"),
        ("rib", "iban", "coordonn", "compte", "banque"),
    ),
    "procuration_mandat": (("procuration", "mandat", "tutelle", "curatelle"),),
    "difficulte_paiement": (
        ("échéancier", "paiement", "difficult", "impayé", "surendett", "chômage"),
    ),
    "deces_succession": (("décès", "défunt", "succession", "décédé", "veuv"),),
    "fraude_suspectee": (
        ("fraud", "escroquer", "usurpation", "pirat", "phishing", "hameçonnage", "autoris"),
    ),
    "menace_juridique": (
        ("avocat", "tribunal", "demeure", "huissier", "judiciaire", "répression",
         "médiateur", "dgccrf", "acpr"),
    ),
    "contestation_explicite": (("contest", "double", "deux"),),
    "hors_perimetre_client": (
        ("journalist", "presse", "interview", "rédaction", "candidature", "motivation",
         "stage", "cv", "recrutement"),
    ),
    V.AUTO_SENDER_LABEL: (("automatique", "répondre"),),
    "engagement_commercial": (
        ("code", "bon", "annul", "exceptionnelle", "commercial"),
    ),
    "lien_externe": (("http", "www."),),
    "meta_ia": (("tant", "langage", "instructions", "prompt"),),
    "engagement_financier": (
        ("remboursement", "virement", "indemnisation"),
        ("valid", "accord", "approuv", "confirm"),
    ),
}

def _guarded_sql(text: str, low: str, odd: str, label: str, pattern: str) -> str:
    groups = " and ".join(
        "(" + " or ".join(f"contains({low}, {sql_text(s)})" for s in group) + ")"
        for group in _NEEDED[label])
    return f"(({groups} or {odd}) and rlike({text}, {sql_text(ci(pattern))}))"


def _matches(text: str, label: str, pattern: str) -> str:
    return _guarded_sql(text, f"lower({text})", has_odd_case_sql(text), label, pattern)


def _joined(pairs: list[tuple[str, str]]) -> str:
    """Labels whose SQL condition holds, in the given order, as one a+b+c text."""
    return f"concat_ws('{LABEL_SEPARATOR}', " + ", ".join(
        f"case when {condition} then {label} end" for condition, label in pairs) + ")"


# --- input side ------------------------------------------------------------------------
def matches_input_rule(text: str, label: str) -> Column:
    """One input rule as a predicate over any text column (or SQL expression)."""
    pattern = {lab: p for lab, p, _ in V.INPUT_RULES}[label]
    return F.expr(_matches(f"coalesce({text}, '')", label, pattern))


def _from_automat(sender: str) -> str:
    return f"rlike(coalesce({sender}, ''), {sql_text(ci(V.AUTO_SENDER_ADDRESS))})"


def is_automatic_sender(sender: str, text: str) -> Column:
    says_so = _matches(f"coalesce({text}, '')", V.AUTO_SENDER_LABEL, V.AUTO_SENDER_TEXT)
    return F.expr(f"{_from_automat(sender)} or {says_so}")


def sensitive_pii(entities: Column | str) -> Column:
    """pii_sensible:X/Y for the bank and identity data found, null when there is none."""
    kinds = F.transform(F.map_keys(col(entities)), F.upper)
    found = F.array_sort(F.array_intersect(
        kinds, F.array(*[F.lit(e) for e in V.SENSITIVE_ENTITIES])))
    return F.when(F.size(found) > 0, F.concat(
        F.lit(f"{V.SENSITIVE_PII_LABEL}:"), F.array_join(found, "/")))


def is_bare_attachment(body: Column | str) -> Column:
    """A body of at most 120 characters that refers to an attachment."""
    b = strip(text_or_empty(body))
    return (F.length(b) <= V.ATTACHMENT_MAX_CHARS) & b.rlike(ci(V.ATTACHMENT_REFERENCE))


def with_input_hits(df: DataFrame, subject: str = "email_subject", body: str = "email_body",
                    sender: str = "email_from", entities: str | None = "pii_entities",
                    out: str = "input_hits") -> DataFrame:
    """Add the triggered input rules, in table order, as a label array.

    Works on the raw text. ``entities`` adds the structural rules; None leaves them out.
    """
    def matches(label: str, pattern: str) -> str:
        return _guarded_sql("__text", "__low", "__odd", label, pattern)

    pairs = [(matches(label, pattern), sql_text(label)) for label, pattern, _ in V.INPUT_RULES]
    says_so = matches(V.AUTO_SENDER_LABEL, V.AUTO_SENDER_TEXT)
    pairs.append((f"{_from_automat(sender)} or {says_so}", sql_text(V.AUTO_SENDER_LABEL)))
    text = f"concat(coalesce({subject}, ''), '\\n', coalesce({body}, ''))"
    added = {"__text": F.expr(text)}
    if entities is not None:
        added["__pii"] = sensitive_pii(entities)
        added["__bare"] = is_bare_attachment(body)
        pairs += [("__pii is not null", "__pii"), ("__bare", sql_text(V.ATTACHMENT_LABEL))]
    work = (
        df.withColumns(added)
        .withColumns({"__low": F.expr("lower(__text)"),
                      "__odd": F.expr(has_odd_case_sql("__text"))})
        .withColumn("__hits", F.expr(_joined(pairs)))
    )
    return evaluate_once(work, {out: labels("__hits")}).drop(
        "__text", "__low", "__odd", "__pii", "__bare", "__hits")


# --- output side -----------------------------------------------------------------------
def matches_output_rule(draft: str, label: str) -> Column:
    pattern = {lab: p for lab, p, _ in V.OUTPUT_RULES}[label]
    return F.expr(_matches(f"coalesce({draft}, '')", label, pattern))


def joined_output_hits(draft: str) -> Column:
    """a+b text of the output rules a draft triggers; '' for a clean or blank draft."""
    d = f"coalesce({draft}, '')"
    return F.expr(_joined([(_matches(d, label, pattern), sql_text(label))
                           for label, pattern, _ in V.OUTPUT_RULES]))


def check_draft_output(draft: str) -> Column:
    return labels(joined_output_hits(draft))


def with_output_hits(df: DataFrame, draft: str = "draft",
                     out: str = "output_hits") -> DataFrame:
    """Add the triggered output rules of a draft as a label array."""
    work = df.withColumn("__hits", joined_output_hits(draft))
    return evaluate_once(work, {out: labels("__hits")}).drop("__hits")


# --- decision ----------------------------------------------------------------------------
def forced_category(categorie: Column | str, categories: Column) -> Column:
    """rules_table:<category> when the (lower-cased) category always needs a human."""
    c = F.lower(F.coalesce(F.nullif(col(categorie), F.lit("")), F.lit(V.DEFAULT_CATEGORY)))
    return F.when(F.array_contains(categories, c), F.concat(F.lit("rules_table:"), c))


def forced_priority(priorite: Column | str, priorities: Column) -> Column:
    p = F.lower(F.coalesce(F.nullif(col(priorite), F.lit("")), F.lit(V.DEFAULT_PRIORITY)))
    return F.when(F.array_contains(priorities, p), F.concat(F.lit("priorite:"), p))


def forced_reason(policy: Policy | Column | None, unjudged: Column | None = None) -> Column:
    """Reason of the first rule that applies, null when none does.

    Expects degenerate, categorie, priorite, input_hits, output_hits, judge_verdict.
    ``unjudged`` marks drafts that no judge could be asked about.
    """
    p = policy_fields(policy)
    sensitive = F.when(
        p["sensitive_rules_enabled"] & (F.size("input_hits") > 0),
        F.concat(F.lit("sensitive:"), F.array_join("input_hits", LABEL_SEPARATOR)))
    unsendable = F.when(
        p["output_guardrail_enabled"] & (F.size("output_hits") > 0),
        F.concat(F.lit("output_guardrail:"), F.array_join("output_hits", LABEL_SEPARATOR)))
    rejected = F.when(F.col("judge_verdict") == "REJECT", F.lit("judge_reject"))
    return F.coalesce(
        F.when(F.col("degenerate"), F.lit("degenerate_input")),
        forced_category("categorie", p["hitl_force_categories"]),
        forced_priority("priorite", p["hitl_force_priorities"]),
        sensitive, unsendable, rejected,
        F.when(F.lit(False) if unjudged is None else unjudged, F.lit("judge_unavailable")))


def _unjudged(df: DataFrame) -> Column | None:
    return F.col("judge_unavailable") if "judge_unavailable" in df.columns else None


def evaluate(df: DataFrame, policy: Policy | Column | None = None) -> DataFrame:
    """Add forced_reason (null when no rule applies)."""
    return df.withColumn("forced_reason", forced_reason(policy, _unjudged(df)))


def decide(df: DataFrame, policy: Policy | Column | None = None) -> DataFrame:
    """Add action, requires_human and decision_reason: rules first, then thresholds.

    With a column judge_unavailable, drafts nobody judged go to a reviewer.
    """
    p = policy_fields(policy)
    confidence = F.coalesce(F.col("confiance").cast("double"), F.lit(0.0))
    approved = F.coalesce(F.col("critic_approved"), F.lit(False))
    forced = F.col("__forced")
    action = (
        F.when(forced.isNotNull(), "HITL")
        .when((confidence >= p["seuil_auto"]) & approved, "AUTO")
        .when(confidence >= p["seuil_hitl"], "HITL")
        .otherwise("MANUAL"))
    return (
        df.withColumn("__forced", forced_reason(policy, _unjudged(df)))
        .withColumn("action", action)
        .withColumn("requires_human", F.col("action") != "AUTO")
        .withColumn("decision_reason", F.coalesce(forced, F.lit("seuils")))
        .drop("__forced")
    )


# --- dictionaries ------------------------------------------------------------------------
def _dictionary(spark: SparkSession, columns: str, rows: list[tuple[str, ...]]) -> DataFrame:
    """A fixed list of texts as a local table."""
    values = ", ".join("(" + ", ".join(sql_text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {values} as t({columns})")


def rule_catalogue(spark: SparkSession, sensitive: bool = True,
                   output: bool = True) -> DataFrame:
    """Rules in force: (side, code, why). Switched-off sides are left out."""
    rows = []
    if sensitive:
        rows += [("entree", label, why) for label, _, why in V.INPUT_RULES]
        rows += [("entree", label, why) for label, why in V.STRUCTURAL_REASONS]
    if output:
        rows += [("sortie", label, why) for label, _, why in V.OUTPUT_RULES]
    names = _dictionary(spark, "side, code, why", rows or [("", "", "")])
    return names if rows else names.where(F.lit(False))


def with_justification(df: DataFrame, label: str, out: str = "why") -> DataFrame:
    """Business reason of a rule label ('' when unknown); text after ':' is ignored.

    The dictionary is the fixed rule catalogue (15 rows), hence the broadcast.
    """
    reasons = rule_catalogue(df.sparkSession).select(
        F.col("code").alias("__code"), F.col("why").alias(out))
    return (
        df.withColumn("__code", F.split_part(text_or_empty(label), F.lit(":"), F.lit(1)))
        .join(F.broadcast(reasons), "__code", "left")
        .withColumn(out, F.coalesce(F.col(out), F.lit("")))
        .drop("__code")
    )


def with_reason_label(df: DataFrame, reason: str = "decision_reason") -> DataFrame:
    """Add escalation_label and escalation_why for a decision reason."""
    names = _dictionary(df.sparkSession, "__base, __label", V.REASON_LABELS)
    full = F.coalesce(F.col(reason), F.lit(""))
    base = F.split_part(
        F.when(full == "", F.lit("seuils")).otherwise(full), F.lit(":"), F.lit(1))
    after = F.when(full.contains(":"), F.regexp_extract(full, r"(?s)^[^:]*:(.*)$", 1)
                   ).otherwise(full)
    first = F.split_part(after, F.lit(LABEL_SEPARATOR), F.lit(1))
    work = (
        df.withColumn("__base", base).withColumn("__first", first)
        .join(F.broadcast(names), "__base", "left")
        .withColumn("escalation_label", F.coalesce("__label", "__base"))
    )
    return with_justification(work, "__first", "escalation_why").drop(
        "__base", "__label", "__first")


# --- reports -----------------------------------------------------------------------------
def deterministic_report(messages: DataFrame) -> DataFrame:
    """Masked parts, entities, client name, degenerate flag and triggered rules.

    No model is involved; a degenerate message triggers no rule.
    """
    hits = with_input_hits(mask_messages(messages))
    return hits.withColumn(
        "rules", F.when(F.col("degenerate"), F.array().cast("array<string>"))
        .otherwise(F.col("input_hits"))).drop("input_hits")


def report_reasons(report: DataFrame, keys: list[str]) -> DataFrame:
    """One row per triggered rule of a deterministic report, with its reason."""
    exploded = report.select(*keys, F.posexplode("rules").alias("ord", "rule"))
    return with_justification(exploded, "rule")


def rule_census(df: DataFrame, by: list[str], hits: str = "input_hits") -> DataFrame:
    """How many messages each rule reaches, per group."""
    return (
        df.select(*by, F.explode(hits).alias("rule"))
        .groupBy(*by, "rule").agg(F.count(F.lit(1)).alias("messages"))
    )

