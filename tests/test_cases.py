import random

import pytest

from sortdesk.operators import audit
from sortdesk.operators import cases as C
from sortdesk.session import written

CASES = [(1, "Brouillon un", "Marie <m@x.fr>"), (2, "voir https://x.fr", "a@x.fr"),
         (3, None, "b@x.fr")]


def case_frame(spark):
    df = spark.createDataFrame(CASES, "case_id long, draft string, email_from string")
    return df.selectExpr(
        "case_id", "draft", "email_from", "'M' || case_id as message_id",
        "cast(null as string) as job_id", "'sujet' as subject_raw", "'' as subject_masked",
        "'demande' as categorie", "'normale' as priorite", "0.5d as confiance",
        "'seuils' as decision_reason", "timestamp_ntz'2024-01-01' as created_at")


def command_frame(spark, rows):
    return spark.createDataFrame(
        rows, "seq long, case_id long, command string, final_draft string").selectExpr(
        "*", "timestamp_seconds(seq)::timestamp_ntz as at", "'a' as decided_by", "'' as comment")


def simulate(rows):
    drafts = {c: d or "" for c, d, _ in CASES}
    final, accepted, refused = dict(drafts), {}, {}
    for seq, case, command, text in sorted(rows):
        bad = lambda t: "https://" in t
        if command not in ("validated", "edited", "rejected"):
            refused[seq] = "unknown_decision"
        elif case not in drafts:
            refused[seq] = "unknown_case"
        elif command == "edited" and not text.strip():
            refused[seq] = "text_required"
        else:
            used = text if command == "edited" else (text or final[case])
            if command != "rejected" and bad(used):
                refused[seq] = "output_guardrail:lien_externe"
                continue
            accepted[seq] = used if command != "rejected" else ""
            if command != "rejected" and used.strip():
                final[case] = used
    return accepted, refused, final


def test_decisions_equal_simulation(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_WIDTH", 7)  # carry over many blocks
    rnd = random.Random(5)
    rows = [(i, rnd.choice([1, 2, 3, 9]),
             rnd.choice(["validated", "validated", "edited", "rejected", "postponed"]),
             rnd.choice(["", "  ", f"texte {i}", "https://x.fr"])) for i in range(200)]
    cases = case_frame(spark)
    accepted, refused = C.apply_decisions(command_frame(spark, rows), cases)
    want_accepted, want_refused, want_final = simulate(rows)
    assert {r.seq: r.final_draft for r in accepted.collect()} == want_accepted
    assert {r.seq: r.refusal for r in refused.collect()} == want_refused
    sends = spark.createDataFrame([], "case_id long, sent_at timestamp_ntz, sent_by string")
    state = C.case_state(cases, accepted, sends)
    assert {r.case_id: r.final_draft for r in state.collect()} == want_final


@pytest.mark.parametrize("cuts", [[0, 200], [0, 1, 60, 199, 200], [0, 50, 50, 100, 150, 200]])
def test_a_stored_fold_equals_the_whole_log(spark, cuts):
    """After any split of the log, late commands of old cases included."""
    rnd = random.Random(6)
    rows = [(i, rnd.choice([1, 2, 3, 9]),
             rnd.choice(["validated", "validated", "edited", "rejected", "postponed"]),
             rnd.choice(["", "  ", f"texte {i}", "https://x.fr"])) for i in range(200)]
    cases = case_frame(spark)
    whole, refused = C.apply_decisions(command_frame(spark, rows), cases)
    fold, seen, left = C.decision_fold(whole.limit(0)), [], []
    for a, b in zip(cuts, cuts[1:]):
        fold, more, less = C.advance(command_frame(spark, rows).where(f"seq >= {a} and seq < {b}"), cases, fold)
        fold = written(fold, "folds")
        seen += [(r.seq, r.final_draft) for r in more.collect()]
        left += [(r.seq, r.refusal) for r in less.collect()]
    assert sorted(seen) == sorted((r.seq, r.final_draft) for r in whole.collect())
    assert sorted(left) == sorted((r.seq, r.refusal) for r in refused.collect())
    sends = spark.createDataFrame([], "case_id long, sent_at timestamp_ntz, sent_by string")
    want = C.case_state(cases, whole, sends)
    got = C.folded_state(cases, fold, sends).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_commands_without_case_are_refused_and_sends_left_alone(spark):
    rows = [(1, None, "validated", ""), (2, 1, "validated", ""), (3, 1, "mark_sent", ""),
            (4, None, "mark_sent", ""), (5, 1, None, "")]
    accepted, refused = C.apply_decisions(command_frame(spark, rows), case_frame(spark))
    assert [r.seq for r in accepted.collect()] == [2]
    assert {r.seq: r.refusal for r in refused.collect()} == {
        1: "unknown_case", 5: "unknown_decision"}
    _, outcome = C.apply_sends(command_frame(spark, rows), case_frame(spark))
    assert {r.seq: r.result for r in outcome.collect()} == {3: "marked_sent", 4: "not_found"}


def test_case_detail_with_decisions(spark):
    rows = [(1, 1, "rejected", ""), (2, 1, "validated", "")]
    cases = case_frame(spark)
    accepted, _ = C.apply_decisions(command_frame(spark, rows), cases)
    sends = spark.createDataFrame([], "case_id long, sent_at timestamp_ntz, sent_by string")
    detail = C.case_detail(C.case_state(cases, accepted, sends), decisions=accepted)
    got = sorted((r.case_id, r.seq, r.decision) for r in detail.collect() if r.seq)
    assert got == [(1, 1, "rejected"), (1, 2, "validated")]
    assert detail.count() == cases.count() + 1


def test_versions_and_casts(spark):
    current = spark.createDataFrame([(2, "a", 1.0), (2, "b", 2.0), (None, "c", 3.0), (None, "c", 3.0)],
                                    "k long, s string, x double")
    older = spark.createDataFrame([("2", "9"), ("7", "no number"), ("7", "4")], "k string, x string")
    got = sorted(map(str, map(tuple, audit.load_versions(current, older, key="k").collect())))
    assert got == ["(2, 'a', 1.0)", "(7, None, None)", "(None, 'c', 3.0)", "(None, 'c', 3.0)"]
    lost = audit.align_schema(older, current.schema, rejects="lost").collect()
    assert [r.lost for r in lost] == [[], ["x"], []]


def test_audit_file_is_standard_csv(spark, tmp_path):
    import csv
    export = spark.createDataFrame([(1, 'il a dit "non", puis'), (2, "deux\nlignes")],
                                   "case_id long, comment string").coalesce(1)
    assert audit.write_audit(export, str(tmp_path / "a")) == 2
    part = next((tmp_path / "a").glob("part-*.csv"))
    with open(part, newline="") as f:
        assert list(csv.reader(f))[1:] == [["1", 'il a dit "non", puis'], ["2", "deux\nlignes"]]


def test_sends(spark):
    rows = [(1, 1, "mark_sent", ""), (2, 1, "mark_sent", ""), (3, 9, "mark_sent", ""),
            (4, 2, "mark_sent", "")]
    cases = case_frame(spark)
    earlier = spark.sql("select 2L case_id, timestamp_ntz'2024-01-01' sent_at, 'r' sent_by")
    new, outcome = C.apply_sends(command_frame(spark, rows), cases, earlier)
    assert {r.seq: r.result for r in outcome.collect()} == {
        1: "marked_sent", 2: "already_sent", 3: "not_found", 4: "already_sent"}
    assert [r.case_id for r in new.collect()] == [1]


def test_ready_to_send_and_journal(spark):
    rows = [(1, 1, "edited", "Bonjour [CLIENT_NAME]"), (2, 3, "rejected", "")]
    cases = case_frame(spark)
    accepted, _ = C.apply_decisions(command_frame(spark, rows), cases)
    sends = spark.createDataFrame([], "case_id long, sent_at timestamp_ntz, sent_by string")
    state = C.case_state(cases, accepted, sends)
    ready = C.ready_to_send(state).collect()
    assert [(r.case_id, r.pii_reinjection) for r in ready] == [
        (1, {"[CLIENT_NAME]": "Marie"})]
    with pytest.raises(ValueError):
        C.ready_to_send(state, 201)
    assert [r.case_id for r in C.journal(cases, accepted).collect()] == [3, 1]
    assert "subject_raw" not in C.case_detail(state).columns
    assert "subject_raw" in C.case_detail(state, include_raw=True).columns


def test_enqueue_first_wins(spark):
    df = spark.createDataFrame([
        (1, "M1", None, True), (2, "M1", None, True), (3, "", "J3", True), (4, "J3", None, True),
        (5, None, "", True), (6, None, None, True), (7, "M7", None, False), (8, "old", None, True),
    ], "created_at int, message_id string, job_id string, requires_human boolean")
    existing = spark.createDataFrame([("old",), (None,)], "case_key string")
    got = C.enqueue(df, existing)
    assert sorted(r.created_at for r in got.collect()) == [1, 3, 5, 6]


def test_gate_and_exports(spark, tmp_path):
    cases = case_frame(spark)
    allowed = spark.createDataFrame([(" marie <M@X.fr>",), ("a@x.fr",)], "email_from string")
    assert [r[0] for r in audit.export_gate(cases, allowed).collect()] == ["b@x.fr"]
    decisions = spark.createDataFrame(
        [(1, 1, "validated")], "seq long, case_id long, decision string").selectExpr(
        "*", "timestamp_ntz'2024-01-01' decided_at", "'a' decided_by", "'' comment",
        "'' final_draft")
    target = tmp_path / "snap"
    assert not audit.export_snapshot(cases, decisions, allowed, str(target))
    assert not target.exists()
    every = allowed.unionByName(spark.createDataFrame([("b@x.fr",)], "email_from string"))
    assert audit.export_snapshot(cases, decisions, every, str(target))
    state = C.case_state(cases, decisions, spark.createDataFrame(
        [], "case_id long, sent_at timestamp_ntz, sent_by string"))
    export = audit.audit_export(state, decisions)
    assert len(export.columns) == 16
    assert audit.write_audit(export, str(tmp_path / "audit")) == 3
    assert audit.write_audit(export.limit(0), str(tmp_path / "none")) == 0
    assert not (tmp_path / "none").exists()
