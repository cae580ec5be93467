"""Review cases as append logs: escalations, decisions, sends, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import masking as M
from ..functions.text import is_blank, text_or_empty
from .ordered import block_of, carry_forward
from .rules import joined_output_hits, with_reason_label

# Sequence numbers per block when a value is carried along a case.
BLOCK_WIDTH = 100_000


def _or_null(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def idempotency_key(message_id: str = "message_id", job_id: str = "job_id") -> Column:
    """Message id, else job id, else null; blank counts as absent."""
    return F.coalesce(_or_null(message_id), _or_null(job_id))


# --- entering the queue --------------------------------------------------------------------
def enqueue(results: DataFrame, existing: DataFrame | None = None, order: tuple = ("created_at",),
            key: str = "case_key") -> DataFrame:
    """Escalations to append: results that need a human, the first one per key.

    Rows without a key never collide. Keys already in ``existing`` are left out. Ranking
    keeps one row per key and task before the shuffle, so a key that is repeated without
    end costs no more than any other.
    """
    wanted = results.where("requires_human").withColumn(key, idempotency_key())
    first = Window.partitionBy(key).orderBy(*order)
    keyed = (
        wanted.where(F.col(key).isNotNull())
        .withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank"))
    if existing is not None:
        keyed = keyed.join(existing.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return keyed.select(*wanted.columns).unionByName(wanted.where(F.col(key).isNull()))


def review_queue(cases: DataFrame, limit: int = 200, order: tuple = ("created_at", "case_id"),
                 status: str = "pending", categorie: str = "") -> DataFrame:
    """Oldest cases first; the limit is the page a reviewer sees."""
    return filter_cases(cases, status, categorie).orderBy(*order).limit(limit)


def filter_cases(cases: DataFrame, status: str = "all", categorie: str = "",
                 ids: DataFrame | None = None, key: str = "case_id") -> DataFrame:
    """Cases by status ('all' or '' for any), category ('' for any) and set of ids."""
    out = cases
    if status and status != "all":
        out = out.where(F.col("status") == status)
    if categorie:
        out = out.where(F.col("categorie") == categorie)
    if ids is not None:
        out = out.join(ids.select(key), key, "left_semi")
    return out


def queue_view(cases: DataFrame) -> DataFrame:
    """Short view of a case without raw text (the raw subject only stands in for none)."""
    subject = F.when(text_or_empty("subject_masked") != "", F.col("subject_masked")).otherwise(
        F.col("subject_raw"))
    keep = ["case_id", F.col("created_at").alias("received_at"), "email_from",
            subject.alias("subject"), "categorie", "priorite", "confiance"]
    keep += ["resume"] if "resume" in cases.columns else []
    return with_reason_label(cases).select(
        *keep, F.col("decision_reason").alias("escalation_code"), "escalation_label",
        "escalation_why", "status")


# --- decisions -----------------------------------------------------------------------------
def apply_decisions(commands: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) reviewer commands (seq, at, case_id, command, final_draft, ...).

    Confirmed sendings (mark_sent) are no decisions; ``apply_sends`` takes them. Refused: an
    unknown decision, an unknown or missing case, an edit without text, a text that
    triggers an output rule. A validation without text takes the draft in force: the last
    accepted text before it, else the original draft. Only commands that bring their own
    clean text change the draft in force, so one carry along each case settles all of it.
    """
    commands = commands.where(~F.col("command").eqNullSafe("mark_sent"))
    known = cases.select(
        "case_id", F.lit(True).alias("__known"), text_or_empty("draft").alias("__original"),
        joined_output_hits("draft").alias("__original_hits"))
    approving = F.col("command").isin(*V.APPROVED)
    own_text = approving & (text_or_empty("final_draft") != "")
    brings = own_text & ~is_blank("final_draft") & (F.col("__own_hits") == "")
    work = commands.withColumn(
        "__own_hits", F.when(own_text, joined_output_hits("final_draft")).otherwise(""))
    work = carry_forward(
        work, keys=["case_id"], order=["seq"], block=block_of("seq", BLOCK_WIDTH),
        value=F.when(brings, F.col("final_draft")), out="__in_force")
    work = work.join(known, "case_id", "left")
    # The draft in force was accepted before, so only an original draft can offend here.
    takes_original = approving & ~own_text & F.col("__in_force").isNull()
    hits = F.when(own_text, F.col("__own_hits")).when(
        takes_original, F.col("__original_hits")).otherwise("")
    text = (
        F.when(own_text, F.col("final_draft"))
        .when(approving, F.coalesce("__in_force", "__original"))
        .otherwise(""))
    refusal = (
        F.when(~F.coalesce(F.col("command").isin(*V.DECISIONS), F.lit(False)), "unknown_decision")
        .when(F.col("__known").isNull(), "unknown_case")
        .when((F.col("command") == "edited") & is_blank("final_draft"), "text_required")
        .when(hits != "", F.concat(F.lit("output_guardrail:"), hits)))
    done = work.withColumns({"refusal": refusal, "__text": text})
    accepted = done.where(F.col("refusal").isNull()).select(
        "seq", "case_id", F.col("at").alias("decided_at"), "decided_by",
        F.col("command").alias("decision"), F.col("__text").alias("final_draft"), "comment")
    refused = done.where(F.col("refusal").isNotNull()).select(
        "seq", "case_id", F.col("at").alias("decided_at"), "decided_by", "command", "refusal")
    return accepted, refused


def history(decisions: DataFrame) -> DataFrame:
    """Decisions in case order, one row each: a long history stays many rows."""
    return decisions.orderBy("case_id", "seq")


def last_decisions(decisions: DataFrame) -> DataFrame:
    """Per case: last decision, draft in force, number of decisions (map-side combined)."""
    sendable = F.col("decision").isin(*V.APPROVED) & ~is_blank("final_draft")
    at = F.struct("seq")
    return decisions.groupBy("case_id").agg(
        F.max_by("decision", at).alias("last_decision"),
        F.max_by("decided_by", at).alias("last_decided_by"),
        F.max_by("decided_at", at).alias("last_decided_at"),
        F.max_by(F.when(sendable, F.col("final_draft")),
                 F.when(sendable, F.col("seq"))).alias("__final"),
        F.count(F.lit(1)).alias("n_decisions"))


# --- a stored fold -------------------------------------------------------------------------
def decision_fold(decisions: DataFrame) -> DataFrame:
    """(case_id, last, final, n): what accepted decisions leave of each case. ``last`` is the last
    decision and ``final`` the last text that can be sent, both behind their seq, so that folds of
    parts of a log can be merged in any order."""
    sendable = F.col("decision").isin(*V.APPROVED) & ~is_blank("final_draft")
    return decisions.groupBy("case_id").agg(
        F.max(F.struct("seq", "decision", "decided_by", "decided_at")).alias("last"),
        F.max(F.when(sendable, F.struct("seq", "final_draft"))).alias("final"),
        F.count(F.lit(1)).alias("n"))


def merge_folds(stored: DataFrame, later: DataFrame) -> DataFrame:
    """One fold of two parts of a log."""
    return stored.unionByName(later).groupBy("case_id").agg(
        F.max("last").alias("last"), F.max("final").alias("final"), F.sum("n").alias("n"))


def advance(commands: DataFrame, cases: DataFrame, stored: DataFrame
            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fold, accepted, refused): new commands judged on a stored fold, and the fold with them.

    The new commands must follow the stored ones in seq; cases they do not touch are not judged
    again. The draft in force of an old case comes from its fold and was clean when it was accepted.
    """
    kept = stored.select("case_id", F.col("final")["final_draft"].alias("__kept"))
    in_force = cases.join(kept, "case_id", "left").withColumn(
        "draft", F.coalesce("__kept", "draft")).drop("__kept")
    accepted, refused = apply_decisions(commands, in_force)
    return merge_folds(stored, decision_fold(accepted)), accepted, refused


def folded_state(cases: DataFrame, fold: DataFrame, sends: DataFrame) -> DataFrame:
    """``case_state`` from a fold of the decisions instead of the decisions."""
    last = F.col("last")
    taken = fold.select(
        "case_id", last["decision"].alias("last_decision"), last["decided_by"].alias("last_decided_by"),
        last["decided_at"].alias("last_decided_at"), F.col("final")["final_draft"].alias("__final"),
        F.col("n").alias("n_decisions"))
    return _with_status(cases, taken, sends)


def first_sends(sends: DataFrame) -> DataFrame:
    return sends.groupBy("case_id").agg(
        F.min("sent_at").alias("sent_at"), F.min_by("sent_by", "sent_at").alias("sent_by"))


def case_state(cases: DataFrame, decisions: DataFrame, sends: DataFrame) -> DataFrame:
    """Cases with status, draft in force and sending; a sent case stays sent."""
    return _with_status(cases, last_decisions(decisions), sends)


def _with_status(cases: DataFrame, taken: DataFrame, sends: DataFrame) -> DataFrame:
    joined = (
        cases.join(taken, "case_id", "left").join(first_sends(sends), "case_id", "left"))
    status = F.when(F.col("sent_at").isNotNull(), F.lit("sent")).otherwise(
        F.coalesce("last_decision", F.lit("pending")))
    return joined.withColumns({
        "status": status,
        "final_draft": F.coalesce("__final", text_or_empty("draft")),
        "n_decisions": F.coalesce("n_decisions", F.lit(0)),
    }).drop("__final")


def case_detail(state: DataFrame, include_raw: bool = False,
                decisions: DataFrame | None = None) -> DataFrame:
    """Queue view plus drafts and decision figures; raw text only when asked for.

    With ``decisions`` a case comes out once for each of its decisions, in seq order within
    the case (undecided cases once, with nulls): a long history stays many rows.
    """
    if decisions is not None:
        steps = decisions.select("case_id", "seq", "decided_at", "decided_by", "decision",
                                 F.col("final_draft").alias("decision_draft"), "comment")
        return case_detail(state, include_raw).join(steps, "case_id", "left")
    extra = ["case_id", F.col("final_draft").alias("draft"),
             F.col("draft").alias("draft_original"), "n_decisions", "last_decision"]
    optional = ("body_masked", "judge_verdict", "judge_scores", "pii_entities", "contexts",
                "cost_usd", "duration_ms")
    extra += [c for c in optional if c in state.columns]
    if include_raw:
        extra += [c for c in ("subject_raw", "body_raw") if c in state.columns]
    view = with_reason_label(state)
    subject = F.when(text_or_empty("subject_masked") != "", F.col("subject_masked")).otherwise(
        F.col("subject_raw"))
    return view.select(
        *extra, F.col("created_at").alias("received_at"), "email_from",
        subject.alias("subject"), "subject_masked", "categorie", "priorite", "confiance",
        F.col("decision_reason").alias("escalation_code"), "escalation_label",
        "escalation_why", "status")


# --- sending -------------------------------------------------------------------------------
def ready_to_send(state: DataFrame, limit: int = 50) -> DataFrame:
    """Approved cases that were never sent, by id, with all the sender needs.

    The limit is the batch the sender asks for (1 to 200).
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie between 1 and 200")
    return (
        state.where(F.col("status").isin(*V.APPROVED) & F.col("sent_at").isNull())
        .orderBy("case_id").limit(limit)
        .withColumn("__name", M.client_name("email_from"))
        .select("case_id", "message_id", "job_id", F.col("email_from").alias("email_to"),
                F.col("subject_raw").alias("subject"), "final_draft",
                M.reinjection_map("final_draft", "__name").alias("pii_reinjection"), "status"))


def apply_sends(commands: DataFrame, cases: DataFrame, sends: DataFrame | None = None
                ) -> tuple[DataFrame, DataFrame]:
    """(new sends, outcome per command) of mark_sent commands.

    The first confirmation of a case wins, later ones report already_sent; a case nobody
    knows reports not_found. The status of the case is not looked at.
    """
    asked = commands.where(F.col("command") == "mark_sent").select(
        "seq", "case_id", "at", "decided_by")
    earlier = sends.select("case_id").distinct().withColumn("__earlier", F.lit(True)) \
        if sends is not None else None
    firsts = asked.groupBy("case_id").agg(F.min("seq").alias("__first"))
    known = cases.select("case_id", F.lit(True).alias("__known"))
    work = asked.join(firsts, "case_id", "left").join(known, "case_id", "left")
    work = (work.join(earlier, "case_id", "left") if earlier is not None
            else work.withColumn("__earlier", F.lit(None).cast("boolean")))
    result = (
        F.when(F.col("__known").isNull(), "not_found")
        .when(F.col("__earlier").isNotNull() | (F.col("seq") != F.col("__first")),
              "already_sent")
        .otherwise("marked_sent"))
    outcome = work.select("seq", "case_id", "at", "decided_by", result.alias("result"))
    new = outcome.where("result = 'marked_sent'").select(
        "case_id", F.col("at").alias("sent_at"), F.col("decided_by").alias("sent_by"))
    return new, outcome.select("seq", "case_id", "result")


# --- journal -------------------------------------------------------------------------------
def journal(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decided cases, newest decision first, time to the minute."""
    return (
        decisions.join(cases.select("case_id", "categorie", "decision_reason"), "case_id")
        .select("case_id", "seq", "categorie", "decision_reason", "decision",
                F.col("decided_by").alias("agent"),
                F.date_format("decided_at", "yyyy-MM-dd HH:mm").alias("decided_minute"),
                F.coalesce("comment", F.lit("")).alias("comment"))
        .orderBy(F.desc("decided_minute"), F.desc("seq")))


def human_decisions_on(metrics: DataFrame, decisions: DataFrame, key: str = "case_id") -> DataFrame:
    """Run metrics with the last human decision of their case ('' when there is none)."""
    last = decisions.groupBy(F.col("case_id").alias("__case")).agg(
        F.max_by("decision", "seq").alias("__decision"))
    return (
        metrics.join(last, F.col(key) == F.col("__case"), "left")
        .withColumn("human_decision", F.coalesce("__decision", F.lit("")))
        .drop("__case", "__decision"))
