from pyspark.sql import functions as F

from sortdesk.functions import masking as M
from sortdesk.operators import guardrail as G


MASKING = [
    ("IBAN fr76 3000 4000 0500 0012 3456 789.", "IBAN [IBAN_MASQUE].", {"IBAN": 1}),
    ("FR7630004000050000123456789", "[IBAN_MASQUE]", {"IBAN": 1}),
    ("DE76 ABCD EFGH", None, {}),
    ("n° 1 85 05 78 006 084 36", "n° [NIR_MASQUE]", {"NIR": 1}),
    ("n° 185052A006084", "n° [NIR_MASQUE]", {"NIR": 1}),
    ("carte 4111 1111 1111 1111", "carte [CB_MASQUE]", {"CB": 1}),
    ("carte 4111 1111 1111 1112 a", None, {}),
    # the separator behind a number goes with it
    ("4111-1111-1111-1111 expire", "[CB_MASQUE]expire", {"CB": 1}),
    ("4111 1111 1111 1111 échue", "[CB_MASQUE]échue", {"CB": 1}),
    ("+33 6.12.34.56.78", "[TEL_MASQUE]", {"TEL": 1}),
    # a phone number needs no boundary on its left
    ("00612345678", "0[TEL_MASQUE]", {"TEL": 1}),
    ("a.b+c@exemple.co.fr, x@y", "[EMAIL_MASQUE], x@y", {"EMAIL": 1}),
    ("06 12 34 56 78 et 07 12 34 56 78 a@b.fr", "[TEL_MASQUE] et [TEL_MASQUE] [EMAIL_MASQUE]",
     {"TEL": 2, "EMAIL": 1}),
    (None, "", {}),
    ("", "", {}),
]


def test_masking(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(MASKING)], "i int, t string")
    rows = G.mask_pii(df.coalesce(1), "t", "m", "e").collect()
    got = {r["i"]: (r["m"], r["e"]) for r in rows}
    for i, (text, want, entities) in enumerate(MASKING):
        assert got[i] == (text if want is None else want, entities)


def test_masking_twice_changes_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    once = G.mask_pii(docs, "text", "m", "e")
    twice = G.mask_pii(once, "m", "m2", "e2")
    assert twice.where("m <> m2 or size(e2) > 0").count() == 0


NAMES = [
    ('"Marie Dupont" <m@x.fr>', "Marie Dupont"), ("Marie <m@x.fr>", "Marie"),
    ("marie.dupont@x.fr", "Marie Dupont"), ("LE-ROUX_jean@x.fr", "Le Roux Jean"),
    ("jean42@x.fr", ""), ("j.dupont@x.fr", "Dupont"), ("service@x.fr", "Service"),
    ("élodie@x.fr", "Élodie"), ("", ""), (None, ""),
]


def test_client_name(spark):
    df = spark.createDataFrame(NAMES, "s string, want string").coalesce(1)
    for r in df.select("want", M.client_name("s").alias("got")).collect():
        assert r["got"] == r["want"]


NAME_MASKS = [
    ("Marie Dupont et marie", "Marie Dupont", "[CLIENT_NAME] et [CLIENT_NAME]", 2),
    ("DUPONT  Marie", "Marie Dupont", "[CLIENT_NAME]", 2),
    ("Dupontel", "Marie Dupont", "Dupontel", 0),
    ("Le Roux, le mur", "Le Roux", "[CLIENT_NAME], le mur", 1),
    ("texte", "", "texte", 0),
]


def test_mask_client_name(spark):
    df = spark.createDataFrame(NAME_MASKS, "t string, n string, want string, hits int")
    df = df.coalesce(1).select("want", "hits", M.mask_client_name("t", "n").alias("r"))
    for r in df.collect():
        assert (r["r"]["text"], r["r"]["n"]) == (r["want"], r["hits"])


def test_guardrail_columns(spark):
    df = spark.createDataFrame([
        ("Marie Dupont <marie@x.fr>", "Pour a@b.fr", "Signé Marie Dupont, 06 12 34 56 78"),
        ("x@y.fr", "s", "  ok \n"), (None, None, None)],
        "email_from string, email_subject string, email_body string")
    a, b, c = G.mask_messages(df).collect()
    assert a["body_masked"] == "Signé [CLIENT_NAME], [TEL_MASQUE]"
    assert a["pii_entities"] == {"TEL": 1, "EMAIL": 1, "NOM": 1} and a["pii_total"] == 3
    assert a["email_from_llm"] == "[CLIENT_NAME] <[EMAIL_MASQUE]>"
    assert b["degenerate"] and b["pii_entities"] == {} and b["pii_engine"] == "none"
    assert c["degenerate"] and c["subject_masked"] == ""


def test_reinjection(spark):
    df = spark.createDataFrame(
        [("Bonjour [CLIENT_NAME] !", "Marie"), ("Bonjour", "Marie"), ("[CLIENT_NAME]", "")],
        "d string, n string").withColumn("m", M.reinjection_map("d", "n"))
    got = [tuple(r) for r in df.select("m", M.reinject("d", "m")).collect()]
    assert got == [({"[CLIENT_NAME]": "Marie"}, "Bonjour Marie !"), ({}, "Bonjour"),
                   ({}, "[CLIENT_NAME]")]


def test_patterns_run_once_per_row(spark):
    """A later filter must not copy the pattern chain below the masking."""
    df = spark.createDataFrame([("a", "b", "c")],
                               "email_from string, email_subject string, email_body string")
    masked = G.mask_messages(df)

    def patterns(frame):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("regexp_replace") + plan.count("RLIKE")

    assert patterns(masked.where(F.col("pii_total") > 0)) == patterns(masked)


def test_mailboxes_are_found_from_the_start_of_a_run_only(spark):
    """The same masks and counts as the fixed pattern itself, on texts of its own characters."""
    import random

    from sortdesk.functions import fixed_values as V
    rng = random.Random(1)
    parts = ["a", "b", "é", "1", ".", "_", "%", "-", "@", "@a.aa", "@b.co", " ", "ſ", "K", "aa", ".fr"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(4000)]
    texts += ["éric@x.fr", "éric.dupont@x.fr", "a@b.co-d@e.fr", "-a@b.fr", "..@b.fr", "_@b.fr", "a@b@c.de",
              "a@b.frx_ c@d.ef", "a.b@c.de.f@g.hi"]
    plain = M.sql_text(M.ci(V.PII_PATTERNS["EMAIL"][0]))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", M.mask_email("t").alias("m"),
        F.expr(f"regexp_replace(t, {plain}, '{M._placeholder(V.PLACEHOLDERS['EMAIL'])[1:-1]}')").alias("want"),
        F.expr(f"regexp_count(t, {plain})").alias("n"))
    rows = df.collect()
    assert sum(r.n for r in rows) > 300
    for r in rows:
        assert (r.m["text"], r.m["n"]) == (r.want, r.n), r.t


def test_masking_a_megabyte_of_dotted_labels(spark):
    import time
    runs = ["a." * 500_000, "a." * 250_000 + " x@" + "b." * 250_000, "1 " * 500_000, "a@" * 500_000,
            "x@y." * 200_000, "a.b " * 250_000 + "@"]
    df = spark.createDataFrame([(t,) for t in runs], "t string").repartition(6)
    start = time.time()
    found = G.pii_leak(G.mask_pii(df, "t", "m", "e"), "t", "leak").select(
        F.length("m").alias("n"), "leak").collect()
    assert len(found) == 6 and time.time() - start < 60
