import json

import pytest

from sortdesk.operators import evaluation as E
from sortdesk.operators import model_io as D
from sortdesk.operators import retrieval as H
from sortdesk.plans import catalog_retrieval as catalog
from sortdesk.plans import views
from sortdesk.sources import labelled, sinks, templates


def test_labelled_files(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    row = {"id": "E1", "email_from": "x@y.fr", "email_subject": "s", "email_body": "b",
           "expected": {"categorie": "demande", "priorite": "basse", "verdict": "HITL"}}
    a.write_text(json.dumps({**row, "notes": "n"}) + "\n\n   \n")
    b.write_text(json.dumps({**row, "id": "A1", "attack_type": "injection"}) + "\n")
    got = {r.id: (r.notes, r.attack_type, r.expected.verdict)
           for r in labelled.read_labelled(spark, str(a), str(b)).collect()}
    assert got == {"E1": ("n", None, "HITL"), "A1": (None, "injection", "HITL")}
    assert labelled.read_labelled(spark, str(a)).count() == 1


def test_broken_labelled_lines_are_named(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"id": "E1", "email_body": "b"}\n{"id": "E2", \n{"email_body": "no id"}\n')
    with pytest.raises(Exception, match="labelled line without a message"):
        labelled.read_labelled(spark, str(f)).collect()
    rows, rejects = labelled.labelled_lines(spark, str(f))
    assert [r.id for r in rows.collect()] == ["E1"]
    assert sorted(tuple(r) for r in rejects.collect()) == [
        ('{"email_body": "no id"}', "no_id"), ('{"id": "E2", ', "broken")]


def test_draft_checks(spark, tmp_path):
    f = tmp_path / "checks.json"
    f.write_text(json.dumps({"_note": {"x": 1}, "A1": {
        "forbidden": ["promo"], "required": ["bonjour"], "must_be_empty": True}, "A2": {}}))
    checks = labelled.read_checks(spark, str(f))
    drafts = spark.createDataFrame(
        [("A1", "Code PROMO", "AUTO"), ("A2", "x", "AUTO"), ("A3", None, "HITL")],
        "id string, draft string, action string")
    got = {r.id: (r.check_failed, r.check_severity) for r in E.with_severity(
        E.check_drafts(drafts, checks, "id")).collect()}
    assert got == {"A1": ("draft_non_vide;interdit:promo;manquant:bonjour", "critique"),
                   "A2": ("", "ok"), "A3": ("", "ok")}


def test_corpus_and_sections(spark, tmp_path):
    (tmp_path / "faq.md").write_text("# Foire\nintro\n## Un \n texte un\r\nsuite\n##  \n## Deux\n")
    (tmp_path / "x.txt").write_text("non")
    docs = labelled.read_corpus(spark, str(tmp_path))
    got = [tuple(r) for r in H.chunk_sections(docs).orderBy("chunk_pos").select(
        "chunk_id", "section", "text").collect()]
    assert got[0] == ("faq-0", "Foire", "# Foire\nintro")
    assert got[1] == ("faq-1", "Un", "Un \n texte un\nsuite")
    assert [g[1] for g in got[2:]] == ["Deux"]
    lexical = H.chunk_sections(docs, min_chars=10).collect()
    assert [r.section for r in lexical] == ["Foire", "Un"]


def test_templates(spark, tmp_path):
    for name in ("judge_v1.9.txt", "judge_v1.10.txt", "drafter_v2.0.txt", "Bad_v1.0.txt"):
        (tmp_path / name).write_text(name)
    catalogue = templates.template_catalogue(templates.template_files(spark, str(tmp_path)))
    chosen, missing = templates.latest_templates(catalogue)
    assert {r.name: r.version for r in chosen.collect()} == {"judge": "1.10", "drafter": "2.0"}
    pins = spark.createDataFrame([("judge", "1.9"), ("drafter", "3.0")],
                                 "name string, version string")
    chosen, missing = templates.latest_templates(catalogue, pins)
    assert [r.content for r in chosen.collect()] == ["judge_v1.9.txt"]
    assert [tuple(r) for r in missing.collect()] == [("drafter", "3.0")]
    row = templates.with_template_versions(spark.range(1), chosen).first()
    assert row["tpl_judge"] == "1.9"


def test_run_metrics_and_eval_files(spark, tmp_path):
    path = str(tmp_path / "metrics")
    df = spark.sql("select 'M1' message_id, 0.12345d confiance, map('TEL', 2) pii_entities, "
                   "1000L tokens_in, 100L tokens_out, 'x' unknown, "
                   "timestamp'2024-01-05 10:00:00' timestamp_utc")
    sinks.write_run_metrics(df, path)
    sinks.write_run_metrics(df, path)
    rows = sinks.read_run_metrics(spark, path).collect()
    assert len(rows) == 2 and "unknown" not in rows[0].asDict()
    assert (rows[0].confiance, rows[0].pii_entities, rows[0].cost_usd) == (0.123, "TEL=2", 0.00056)
    assert str(rows[0].run_date) == "2024-01-05"
    assert sinks.schema_version() != sinks.schema_version([("a", "int")])
    sinks.write_eval(spark.sql("select 1 id, array('a', 'b') l"), spark.range(1), path + "/e")
    assert spark.read.option("header", True).csv(path + "/e/detail").first()["l"] == "a | b"


SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_lexical_blocks_agree(spark):
    q, p = catalog.questions(spark, SF), catalog.passages(spark, SF)
    want = rows(H.lexical_topk(q, p, 3))
    assert want == rows(H.lexical_topk(q, p, 3, block_bits=0, first_blocks=1))
    assert want == rows(H.lexical_topk(q, p, 3, block_bits=4, first_blocks=30))


def test_vector_cells_and_tiles_agree(spark, monkeypatch):
    v = views.table(spark, SF, "embeddings").select("vec_id", "embedding")
    q = v.withColumnRenamed("vec_id", "query_id")
    want = rows(H.vector_topk(q, v, 3, exclude_self=True))
    assert want == rows(H.vector_topk(q, v, 3, exclude_self=True, cell_rows=20, block_floats=640))
    monkeypatch.setattr(H, "TILE", 700)
    assert want == rows(H.vector_topk(q, v, 3, exclude_self=True))


def test_vectors_without_place(spark):
    nan = float("nan")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [nan, 1.0]),
                               ("e", [0.0, 1.0])], "vec_id string, embedding array<double>")
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", None)],
                              "query_id string, embedding array<double>")
    assert [tuple(r) for r in H.vector_topk(q, v, 5).orderBy("rank").collect()] == [
        ("x", "a", 0.0, 1), ("x", "e", 2.0, 2)]
    near = H.vector_topk_approx(q, v.where("vec_id in ('a', 'e')"), 2.0, 5).collect()
    assert ("x", "a") in {(r.query_id, r.vec_id) for r in near}


def test_corpus_to_contexts(spark, tmp_path):
    """Markdown files, sections, passages for message texts: all with text ids."""
    (tmp_path / "faq.md").write_text("# Foire\n## Facture\nVotre facture arrive chaque trimestre ici.\n")
    (tmp_path / "contrat.md").write_text("## Contrat\nLe contrat annuel se termine au printemps suivant.\n")
    chunks = H.chunk_sections(labelled.read_corpus(spark, str(tmp_path)), min_chars=20)
    asked = spark.createDataFrame(
        [("M1", "facture du trimestre"), ("M2", "contrat annuel, facture"), ("M3", "rien")],
        "query_id string, text string")
    hits = H.lexical_topk(asked, chunks, 2, order=("source", "chunk_pos"))
    assert {(r.query_id, r.source, r["rank"]) for r in hits.collect()} == {
        ("M1", "faq", 1), ("M2", "contrat", 1), ("M2", "faq", 2)}
    got = H.contexts(H.retrieve(asked, chunks, None, 2, order=("source", "chunk_pos")))
    assert {r.query_id: len(r.contexts) for r in got.collect()} == {"M1": 1, "M2": 2}


def test_vectors_without_passage_take_no_place(spark):
    chunks = spark.createDataFrame([("s", 1, 0, "texte un"), ("s", 3, 0, "texte trois")],
                                   "source string, doc_id long, chunk_pos long, text string")
    vectors = spark.createDataFrame([(1, [0.0], 1, 0), (2, [0.1], 2, 0), (3, [0.2], 3, 0)],
                                    "vec_id long, embedding array<double>, doc_id long, chunk_pos long")
    asked = spark.createDataFrame([(9, "q", [0.0])], "query_id long, text string, embedding array<double>")
    got = H.retrieve(asked, chunks, vectors, 2).orderBy("rank").collect()
    assert [r.context for r in got] == ["[s] texte un", "[s] texte trois"]


def test_retrieve_blank_and_limits(spark):
    q = spark.createDataFrame([(1, "  "), (2, "ab")], "query_id long, text string")
    p = catalog.passages(spark, SF)
    assert H.retrieve(q, p, None).count() == 0
    with pytest.raises(ValueError):
        H.kb_search(q, p, 11)


def test_floored_rank(spark):
    for n, want in ((1, 0), (2, 1), (20, 19), (100, 95)):
        df = spark.range(1, n + 1).select("id")
        assert E.floored_rank(df, "id", []).first()["p95"] == want


@pytest.mark.parametrize("raw, fields", [
    ('{"categorie": "spam", "confiance": "0.5"}', ("spam", "normale", 0.5, None)),
    ('[1]', ("autre", "normale", 0.0, "[classifier] unusable output")),
    (None, ("autre", "normale", 0.0, "[classifier] unusable output")),
])
def test_classifier_fallback(spark, raw, fields):
    df = spark.createDataFrame([(raw,)], "completion string")
    r = D.parse_classification(df)[0].first()
    assert (r.categorie, r.priorite, r.confiance, r.classifier_error) == fields


def test_final_attempt(spark):
    df = spark.createDataFrame(
        [(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False), (2, 2, False), (2, 3, True),
         (3, 1, True), (4, 1, False)], "conv_id long, attempt long, critic_approved boolean")
    got = {r.conv_id: (r.attempt, r.drafter_retries) for r in D.final_attempt(df).collect()}
    assert got == {1: (2, 1), 2: (2, 2), 3: (1, 0), 4: (1, 1)}
