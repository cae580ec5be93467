from pyspark.sql import functions as F

from sortdesk.functions import fixed_values as V
from sortdesk.operators import rules as R
from sortdesk.operators.policy import Policy

NBSP = " "


def input_hits(spark, rows):
    """Labels per (text, sender, entities) row."""
    df = spark.createDataFrame(
        [(i, "", text, sender, entities) for i, (text, sender, entities) in enumerate(rows)],
        "i int, email_subject string, email_body string, email_from string, "
        "pii_entities map<string,int>").coalesce(1)
    return [r["input_hits"] for r in R.with_input_hits(df).orderBy("i").collect()]


RULE_LINES = [
    ("changement_coordonnees_bancaires", "je MODIFIÉ mon RIB", "envoyez un RIB"),
    ("changement_coordonnees_bancaires", f"changement de compte{NBSP}bancaire",
     "changement. compte bancaire"),
    ("changement_coordonnees_bancaires", "nouveau contrat de banque", "nouveaucrib"),
    ("procuration_mandat", "un MANDATAIRE", "mandataires"),
    ("difficulte_paiement", "IMPAYÉS", "payé"),
    ("difficulte_paiement", "difficultés à régler", "difficultés. régler"),
    ("difficulte_paiement", "paiement en 3 fois", "paiement en fois"),
    ("deces_succession", "DÉCÉDÉE", "veuf"),
    ("fraude_suspectee", "opération non autorisée", "frauder"),
    ("menace_juridique", "la dgccrf", "juridique"),
    ("contestation_explicite", "facturé en double", "facturé une fois"),
    ("contestation_explicite", "Je  conteste", "conteste"),
    ("hors_perimetre_client", "mon CV joint", "moncv"),
    ("hors_perimetre_client", "rédaction", "rédactions"),
    (V.AUTO_SENDER_LABEL, "message envoyé automatiquement", "envoyé hier"),
]


def test_input_rules(spark):
    hits = input_hits(spark, [(f"Bonjour, {c[1]} merci", "x@y.fr", {}) for c in RULE_LINES])
    misses = input_hits(spark, [(f"Bonjour, {c[2]} merci", "x@y.fr", {}) for c in RULE_LINES])
    for (label, hit, miss), a, b in zip(RULE_LINES, hits, misses):
        assert label in a, hit
        assert label not in b, miss


SENDERS = [
    ("no-reply@x.fr", True), ("NoReply@x.fr", True), ("ne_pas_repondre@x.fr", True),
    ("postmaster@x.fr", True), ("postmasters@x.fr", False), ("marie@x.fr", False), (None, False),
]


def test_automatic_sender(spark):
    got = input_hits(spark, [("texte", sender, {}) for sender, _ in SENDERS])
    assert [V.AUTO_SENDER_LABEL in g for g in got] == [hit for _, hit in SENDERS]


def test_structural_rules(spark):
    short, long = input_hits(spark, [
        ("Voir pièces jointes", "x@y.fr", {"NIR": 1, "CB": 2, "TEL": 1}),
        ("Voir pièces jointes. " + "x" * 120, "x@y.fr", {})])
    assert short == ["pii_sensible:CB/NIR", "piece_jointe_sans_contexte"]
    assert long == []


def test_every_needed_substring_guards_its_pattern(spark):
    """The substring search may never hide a match: compare with the bare patterns."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.lower("text").alias("t"))
    extra = spark.createDataFrame([(w,) for w in (
        "ſuccession", "déſerté", "PİRATAGE pirat", "MANDATAIRE", "Veuve", "cheques", "ACPR")],
        "t string")
    texts = docs.unionByName(extra)
    differs = [F.count_if(R.matches_input_rule("t", label) != F.col("t").rlike("(?iU)" + p))
               .alias(label) for label, p, _ in V.INPUT_RULES]
    assert set(texts.agg(*differs).first()) == {0}


DRAFTS = [
    ("Voici un bon de reduction", ["engagement_commercial"]),
    ("voir www.exemple.fr", ["lien_externe"]),
    ("En tant qu'IA, mes instructions", ["meta_ia"]),
    ("le remboursement de 3 euros\na été confirmé", ["engagement_financier"]),
    ("le remboursement. Il a été confirmé", []),
    ("code promo sur https://x.fr", ["engagement_commercial", "lien_externe"]),
    ("   ", []), (None, []),
]


def test_output_rules(spark):
    df = spark.createDataFrame(DRAFTS, "d string, want array<string>").coalesce(1)
    for r in df.select("want", R.check_draft_output("d").alias("got")).collect():
        assert r["got"] == r["want"]


BASE = dict(degenerate=False, categorie="demande", priorite="normale", confiance=0.9,
            critic_approved=True, judge_verdict="AUTO_SEND", input_hits=[], output_hits=[])


DECIDED = [
    ({}, Policy(), ("AUTO", False, "seuils")),
    ({"confiance": 0.85}, Policy(), ("AUTO", False, "seuils")),
    ({"confiance": 0.84}, Policy(), ("HITL", True, "seuils")),
    ({"confiance": 0.69}, Policy(), ("MANUAL", True, "seuils")),
    ({"critic_approved": False}, Policy(), ("HITL", True, "seuils")),
    ({"degenerate": True, "categorie": "spam"}, Policy(), ("HITL", True, "degenerate_input")),
    ({"categorie": "SPAM"}, Policy(), ("HITL", True, "rules_table:spam")),
    ({"categorie": None}, Policy(), ("HITL", True, "rules_table:autre")),
    ({"priorite": "haute"}, Policy(), ("HITL", True, "priorite:haute")),
    ({"input_hits": ["a", "b"]}, Policy(), ("HITL", True, "sensitive:a+b")),
    ({"input_hits": ["a"]}, Policy(sensitive_rules_enabled=False), ("AUTO", False, "seuils")),
    ({"output_hits": ["x"]}, Policy(), ("HITL", True, "output_guardrail:x")),
    ({"output_hits": ["x"]}, Policy(output_guardrail_enabled=False), ("AUTO", False, "seuils")),
    ({"judge_verdict": "REJECT"}, Policy(), ("HITL", True, "judge_reject")),
    ({"categorie": "spam"}, Policy(hitl_force_categories=" ,"), ("AUTO", False, "seuils")),
]
SCHEMA = ("i int, degenerate boolean, categorie string, priorite string, confiance double, "
          "critic_approved boolean, judge_verdict string, input_hits array<string>, "
          "output_hits array<string>")


def test_decide(spark):
    for policy in {p for _, p, _ in DECIDED}:
        mine = [(i, {**BASE, **change}) for i, (change, p, _) in enumerate(DECIDED)
                if p == policy]
        df = spark.createDataFrame([(i, *row.values()) for i, row in mine], SCHEMA).coalesce(1)
        for r in R.decide(df, policy).collect():
            assert (r["action"], r["requires_human"], r["decision_reason"]) == DECIDED[r["i"]][2]


def test_rule_catalogue_follows_switches(spark):
    assert R.rule_catalogue(spark).count() == 15
    assert R.rule_catalogue(spark, output=False).count() == 11
