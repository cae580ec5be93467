"""The tables around the model calls: prompts going in, completions coming out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.once import evaluate_once
from ..functions.text import is_blank, strip, text_or_empty
from .policy import Policy, policy_fields

NO_SENDER = "unknown"
NO_PASSAGES = "none"
ANSWER_NOTE = (f"Answer in French, in a few lines. Where the customer is named, write "
               f"{V.CLIENT_PLACEHOLDER}.")


# --- prompts -------------------------------------------------------------------------------
def _slots(*slots: tuple[str, Column]) -> Column:
    """One 'name: value' line for each slot."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in slots])


def _message_slots() -> list[tuple[str, Column]]:
    sender = F.coalesce(F.nullif(F.col("email_from_llm"), F.lit("")), F.lit(NO_SENDER))
    return [("sender", sender), ("subject", text_or_empty("subject_masked")),
            ("body", strip(text_or_empty("body_masked")))]


def _class_slots() -> list[tuple[str, Column]]:
    return [("category", F.coalesce("categorie", F.lit(V.DEFAULT_CATEGORY))),
            ("priority", F.coalesce("priorite", F.lit(V.DEFAULT_PRIORITY)))]


def classifier_prompt() -> Column:
    return _slots(*_message_slots())


def drafter_prompt() -> Column:
    """Message, class, passages, what the last review refused, and how to answer."""
    passages = F.coalesce(F.nullif(F.array_join("contexts", " / "), F.lit("")),
                          F.lit(NO_PASSAGES))
    refused = (text_or_empty("critic_feedback") != "") & ~F.coalesce(
        F.col("critic_approved"), F.lit(True))
    review = F.when(refused, F.concat_ws(
        "; ", "critic_feedback", F.nullif(F.array_join("critic_issues", ", "), F.lit(""))))
    return F.concat_ws(
        "\n", _slots(*_message_slots(), *_class_slots(), ("summary", text_or_empty("resume")),
                     ("passages", passages)),
        F.concat(F.lit("refused before: "), review), F.lit(ANSWER_NOTE))


def judge_prompt() -> Column:
    return _slots(("body", strip(text_or_empty("body_masked"))), *_class_slots(),
                  ("draft", F.col("draft")))


_PROMPTS = {"classifier": classifier_prompt, "drafter": drafter_prompt, "judge": judge_prompt}
_DRAFTER_INPUT = {
    "contexts": "array<string>", "critic_feedback": "string", "critic_approved": "boolean",
    "critic_issues": "array<string>", "resume": "string",
    "categorie": "string", "priorite": "string",
}


def prompts_for(df: DataFrame, agent: str, templates: DataFrame | None = None) -> DataFrame:
    """Add the prompt of one agent for the rows that may be sent to a model.

    Degenerate messages never are; a blank body is not classified and a blank draft not
    judged. The filter comes before any model call. ``templates`` (name, version,
    content) adds the system prompt and its version; of several rows of an agent the
    greatest version (as text) is taken, so no prompt is doubled.
    """
    for name, kind in _DRAFTER_INPUT.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    wanted = ~F.coalesce(F.col("degenerate"), F.lit(False))
    if agent == "classifier":
        wanted = wanted & ~is_blank("body_masked")
    if agent == "judge":
        wanted = wanted & ~is_blank("draft")
    out = df.where(wanted).withColumn("agent", F.lit(agent)).withColumn(
        "prompt", _PROMPTS[agent]())
    if templates is None:
        return out
    chosen = templates.where(F.col("name") == agent).select(
        F.col("name").alias("agent"), F.col("content").alias("system_prompt"),
        F.col("version").alias(f"tpl_{agent}"))
    chosen = chosen.groupBy("agent").agg(
        F.max_by("system_prompt", f"tpl_{agent}").alias("system_prompt"),
        F.max(f"tpl_{agent}").alias(f"tpl_{agent}"))
    return out.join(F.broadcast(chosen), "agent", "left")


def infer(prompts: DataFrame, call: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Batch hook for a model: ``call`` maps an iterator of pandas batches.

    Model answers differ from call to call, so write or persist the result before it is
    read more than once.
    """
    return prompts.mapInPandas(call, schema)


# --- classifier output ---------------------------------------------------------------------
def _field(name: str, kind: str) -> Column:
    return F.try_variant_get("__json", f"$.{name}", kind)


def _kind(name: str) -> Column:
    """Variant type of a field: STRING, BIGINT, VOID for null, null when it is missing."""
    return F.schema_of_variant(F.try_variant_get("__json", f"$.{name}", "variant"))


def _is_object(raw: str) -> Column:
    return F.schema_of_variant("__json").startswith("OBJECT")


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def parse_classification(df: DataFrame, raw: str = "completion") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) rows of a classifier completion.

    Missing fields take defaults; text that is no JSON object, or a confidence that is no
    number, turns the whole row into the fallback class with a note. Fields that break
    the contract (unknown category or priority, confidence outside 0..1, wrong type) send
    the row to quarantine with the names of these fields.
    """
    kind = _kind("confiance")
    text_number = strip(_field("confiance", "string")).try_cast("double")
    as_text = _field("confiance", "string")
    confidence = (
        F.when(kind.isNull() | (kind == "VOID"), F.lit(0.0))
        .when(kind == "BOOLEAN", _field("confiance", "boolean").cast("int").cast("double"))
        .when(_is_number(kind), _field("confiance", "double"))
        .when(kind == "STRING", F.when(as_text == "", F.lit(0.0)).otherwise(text_number))
        .when(kind.isin("ARRAY<VOID>", "OBJECT<>"), F.lit(0.0)))
    usable = F.coalesce(_is_object(raw), F.lit(False)) & F.col("__confidence").isNotNull()
    work = (
        df.withColumn("__json", F.try_parse_json(F.col(raw)))
        .withColumn("__confidence", confidence)
        .withColumn("__usable", usable)
    )

    def with_default(name: str, default) -> Column:
        given = _field(name, "string")
        return F.when(~F.col("__usable") | _kind(name).isNull(), F.lit(default)).otherwise(given)

    def breaks(name: str, *allowed: str) -> Column:
        k = _kind(name)
        return F.col("__usable") & k.isNotNull() & ~k.isin(*allowed)

    work = evaluate_once(work, {
        "categorie": with_default("categorie", V.DEFAULT_CATEGORY),
        "priorite": with_default("priorite", V.DEFAULT_PRIORITY),
        "resume": with_default("resume", ""),
        "expediteur": with_default("expediteur", None),
        "action_suggeree": with_default("action_suggeree", None),
        "confiance": F.when(F.col("__usable"), F.col("__confidence")).otherwise(0.0),
        "classifier_error": F.when(~F.col("__usable"), F.lit("[classifier] unusable output")),
        "__wrong_type": F.concat_ws(
            ",", *[F.when(breaks(n, "STRING"), F.lit(n))
                   for n in ("categorie", "priorite", "resume")],
            *[F.when(breaks(n, "STRING", "VOID"), F.lit(n))
              for n in ("expediteur", "action_suggeree")]),
    })
    violation = F.concat_ws(
        ",", F.nullif(F.col("__wrong_type"), F.lit("")),
        F.when(~F.col("categorie").isin(*V.CATEGORIES)
               & ~F.col("__wrong_type").contains("categorie"), F.lit("categorie")),
        F.when(~F.col("priorite").isin(*V.PRIORITIES)
               & ~F.col("__wrong_type").contains("priorite"), F.lit("priorite")),
        F.when(~F.col("confiance").between(0.0, 1.0) | F.isnan("confiance"),
               F.lit("confiance")))
    work = work.withColumn("violation", violation).drop(
        "__json", "__confidence", "__usable", "__wrong_type")
    return (work.where(F.col("violation") == "").drop("violation"),
            work.where(F.col("violation") != ""))


# --- judge output --------------------------------------------------------------------------
def _lax_int(name: str) -> Column:
    """A whole number given as a number, a text or a boolean; null otherwise."""
    kind = _kind(name)
    number = F.when(kind == "BOOLEAN", _field(name, "boolean").cast("int").cast("double")
                    ).when(kind == "STRING", strip(_field(name, "string")).try_cast("double")
                           ).when(_is_number(kind), _field(name, "double"))
    return F.when((number == F.floor(number)) & (F.abs(number) < 1e9), number.cast("int"))


def judge_score(scores: list[Column | str] | None = None) -> Column:
    """Mean of the four criteria on a 0..1 scale."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (scores or V.JUDGE_CRITERIA)]
    return sum(cols[1:], cols[0]).cast("double") / 20


def is_approved(verdict: Column, score: Column, policy: Policy | Column | None = None) -> Column:
    return (verdict == "AUTO_SEND") & (score >= policy_fields(policy)["critic_approve_threshold"])


def parse_judge(df: DataFrame, raw: str = "completion", policy: Policy | Column | None = None,
                outage: str = "closed") -> DataFrame:
    """Add scores, verdict, feedback, issues, score and approval of a judge completion.

    An object that breaks the contract is never approved. Text that is no JSON object
    counts the same way; outage="open" accepts such a draft with score 0.5 instead. ``judge_unavailable`` tells
    drafts that nobody judged; ``decide`` sends them to a reviewer under that name.
    """
    issues_kind = _kind("issues")
    issues_ok = issues_kind.isNull() | issues_kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
    issues_ok = issues_ok & (
        F.coalesce(issues_kind != "ARRAY<VOID>", F.lit(True))
        | (F.coalesce(F.size(_field("issues", "array<string>")), F.lit(0)) == 0))
    feedback_kind = _kind("feedback")
    work = df.withColumn("__json", F.try_parse_json(F.col(raw)))
    work = evaluate_once(work, {
        "__object": F.coalesce(_is_object(raw), F.lit(False)),
        **{f"__{c}": _lax_int(c) for c in V.JUDGE_CRITERIA},
        "__verdict": F.when(_kind("verdict") == "STRING", _field("verdict", "string")),
        "__feedback": F.when(feedback_kind.isNull(), F.lit(""))
        .when(feedback_kind == "STRING", _field("feedback", "string")),
        "__issues": F.when(issues_kind.isNull(), F.array().cast("array<string>"))
        .when(issues_ok, _field("issues", "array<string>")),
    })
    in_range = [F.coalesce(F.col(f"__{c}").between(1, 5), F.lit(False))
                for c in V.JUDGE_CRITERIA]
    valid = (F.col("__object") & in_range[0] & in_range[1] & in_range[2] & in_range[3]
             & F.coalesce(F.col("__verdict").isin(*V.VERDICTS), F.lit(False))
             & F.col("__feedback").isNotNull() & F.col("__issues").isNotNull())
    ok, opened = F.col("__valid"), F.col("__opened")
    work = work.withColumn("__valid", valid).withColumn(
        "__opened", ~F.col("__object") & F.lit(outage == "open"))
    for c in V.JUDGE_CRITERIA:
        work = work.withColumn(c, F.when(ok, F.col(f"__{c}")))
    score = F.when(ok, judge_score()).when(opened, 0.5).otherwise(0.0)
    return (
        work.withColumn("judge_verdict",
                        F.when(ok, F.col("__verdict")).otherwise("HUMAN_REVIEW"))
        .withColumn("critic_score", score)
        .withColumn("critic_approved", opened | (ok & is_approved(
            F.col("judge_verdict"), F.col("critic_score"), policy)))
        .withColumn("critic_feedback", F.when(ok, F.col("__feedback"))
                    .when(opened, "judge_unavailable")
                    .otherwise("judge_output_unusable"))
        .withColumn("critic_issues", F.when(ok, F.col("__issues"))
                    .when(opened, F.array().cast("array<string>"))
                    .otherwise(F.array(F.lit("judge_invalid_output"))))
        .withColumn("judge_unavailable", ~F.col("__object") & F.lit(outage != "open"))
        .drop("__json", "__object", "__verdict", "__feedback", "__issues", "__valid",
              "__opened", *[f"__{c}" for c in V.JUDGE_CRITERIA])
    )


def approve(df: DataFrame, policy: Policy | Column | None = None) -> DataFrame:
    """Add critic_score and critic_approved from judged columns.

    A blank draft is never approved and carries the issue empty_draft.
    """
    blank = is_blank("draft")
    return (
        df.withColumn("critic_score", F.when(blank, 0.0).otherwise(judge_score()))
        .withColumn("critic_approved", ~blank & F.coalesce(is_approved(
            F.col("judge_verdict"), F.col("critic_score"), policy), F.lit(False)))
        .withColumn("critic_issue", F.when(blank, F.lit("empty_draft")).otherwise(""))
    )


def rubric_check(df: DataFrame) -> DataFrame:
    """Add the verdict the scores stand for and whether the declared one contradicts it."""
    lowest = F.least(*V.JUDGE_CRITERIA)
    derived = (F.when(lowest >= 4, "AUTO_SEND").when(lowest == 3, "HUMAN_REVIEW")
               .otherwise("REJECT"))
    return df.withColumn("rubric_verdict", derived).withColumn(
        "rubric_conflict", F.col("rubric_verdict") != F.col("judge_verdict"))


# --- attempts and usage --------------------------------------------------------------------
def final_attempt(attempts: DataFrame, key: str = "conv_id", order: str = "attempt",
                  max_retries: int = V.MAX_DRAFT_RETRIES) -> DataFrame:
    """The attempt a message ends with: the first approved one, or the last allowed refusal.

    Attempts after that one never happened. Only the first few attempts of a message are
    ranked, so the ranking is cut down before the shuffle and long histories do not pile
    up in one task.
    """
    w = Window.partitionBy(key).orderBy(order)
    first = attempts.withColumn("__n", F.row_number().over(w)).where(
        F.col("__n") <= max_retries)
    stop = F.coalesce(F.min(F.when(F.col("critic_approved"), F.col("__n"))), F.max("__n"))
    # At most max_retries rows per message are left here.
    last = first.groupBy(F.col(key).alias("__key")).agg(stop.alias("__stop"))
    return (
        first.join(last, (F.col(key) == F.col("__key")) & (F.col("__n") == F.col("__stop")))
        .withColumn("drafter_retries",
                    F.col("__stop") - F.col("critic_approved").cast("int"))
        .drop("__key", "__n", "__stop")
    )


def usage_totals(messages: DataFrame, calls: DataFrame, key: str = "conv_id") -> DataFrame:
    """Tokens and number of model calls per message; messages without calls get zeros."""
    totals = calls.groupBy(key).agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.count(F.lit(1)).alias("llm_calls"))
    names = ("tokens_in", "tokens_out", "llm_calls")
    joined = messages.join(totals, key, "left")
    return joined.select(
        *[c for c in messages.columns if c not in names],
        *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names])


# --- model-free baseline -------------------------------------------------------------------
def train_classifier(labelled: DataFrame, text: str = "text", label: str = "label",
                     features: int = 1 << 16, iterations: int = 20, ridge: float = 0.1):
    """Bag-of-words baseline with the classifier's contract (label and probability).

    Without a penalty, words of single documents fit the training rows and lose on others."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    stages = [
        StringIndexer(inputCol=label, outputCol="__y", handleInvalid="skip",
                      stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="__words", gaps=False, pattern=V.TERM),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features),
        IDF(inputCol="__tf", outputCol="__x"),
        LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=iterations, regParam=ridge),
    ]
    return Pipeline(stages=stages).fit(labelled)


def score_classifier(model, df: DataFrame, out: str = "categorie") -> DataFrame:
    """Add the predicted label and its probability as ``confiance``."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[0].labels
    scored = PipelineModel(model.stages[1:]).transform(df)
    names = F.array(*[F.lit(v) for v in labels])
    return (
        scored.withColumn(out, F.element_at(names, F.col("prediction").cast("int") + 1))
        .withColumn("confiance", F.array_max(vector_to_array("probability")))
        .drop("__words", "__tf", "__x", "rawPrediction", "probability", "prediction")
    )
