"""Guardrail jobs: mask personal data in whole message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import masking as M
from ..functions.once import evaluate_once
from ..functions.text import stripped_length_below, text_or_empty


def is_degenerate(body: Column | str, min_chars: int = V.DEGENERATE_MIN_CHARS) -> Column:
    return stripped_length_below(body, min_chars)


def mask_columns(df: DataFrame, outputs: dict[str, tuple[str, str]],
                 entities: tuple[str, ...] = tuple(V.PII_PATTERNS)) -> DataFrame:
    """Mask several text columns: {text column: (masked column, entity map column)}.

    The entities are masked one after the other, each on the output of the step before, and
    every step is one projection over all columns, so no pattern runs twice. ``entities``
    may stop short of the last ones where only the first are asked for.
    """
    names = list(outputs)
    mask = {t: f"__mask{i}" for i, t in enumerate(names)}
    digits = {t: f"__digits{i}" for i, t in enumerate(names)}
    count = {(t, e): f"__n{i}_{e}" for i, t in enumerate(names) for e in entities}
    start = {}
    for t in names:
        text = f"coalesce(`{t}`, '')"
        start[mask[t]] = F.expr(f"named_struct('text', {text})")
        start[digits[t]] = F.expr(M.digit_run_sql(text))
    work, previous = df.withColumns(start), None
    for entity in entities:
        step = {mask[t]: F.expr(M.mask_sql(f"{mask[t]}.text", entity, digits[t]))
                for t in names}
        if previous:
            step |= {count[t, previous]: F.col(mask[t])["n"] for t in names}
        work = work.withColumns(step)
        previous = entity
    found = {t: {e: f"{mask[t]}.n" if e == previous else count[t, e]
                 for e in entities} for t in names}
    done = evaluate_once(work, {
        **{outputs[t][0]: F.col(mask[t])["text"] for t in names},
        **{outputs[t][1]: M.entity_map(found[t]) for t in names}})
    return done.drop(*mask.values(), *digits.values(), *count.values())


def mask_pii(df: DataFrame, text: str, out: str | None = None,
             entities: str | None = None) -> DataFrame:
    """Add the masked text and the entity map of one text column."""
    return mask_columns(
        df, {text: (out or f"{text}_masked", entities or f"{text}_entities")})


def mask_messages(df: DataFrame) -> DataFrame:
    """Guardrail over a message table (email_from, email_subject, email_body).

    Adds client_name, subject_masked, body_masked, email_from_llm, pii_entities,
    pii_engine, pii_total and degenerate. Degenerate bodies are masked as well; their
    entity report stays empty because they never reach a rule or a model.
    """
    parts = ("email_subject", "email_body", "email_from")
    work = df.withColumns({
        "degenerate": is_degenerate("email_body"),
        "client_name": M.client_name("email_from")})
    work = mask_columns(work, {p: (f"__{p}", f"__{p}_pii") for p in parts})
    work = work.withColumns({
        f"__{p}": M.mask_client_name(f"__{p}", "client_name") for p in parts})
    n_name = F.col("__email_subject")["n"] + F.col("__email_body")["n"]
    merged = M.merge_entities(F.col("__email_body_pii"), F.col("__email_subject_pii"), n_name)
    entities = F.when(F.col("degenerate"), M.empty_entities()).otherwise(merged)
    work = evaluate_once(work, {
        "subject_masked": F.col("__email_subject")["text"],
        "body_masked": F.col("__email_body")["text"],
        "email_from_llm": F.col("__email_from")["text"],
        "pii_entities": entities,
        "pii_engine": F.when(F.col("degenerate"), V.NO_ENGINE).otherwise(V.REGEX_ENGINE),
        "pii_total": M.entities_total(entities),
    })
    return work.drop(*[c for p in parts for c in (f"__{p}", f"__{p}_pii")])


def with_sensitive_entities(df: DataFrame) -> DataFrame:
    """Add degenerate and pii_entities, as far as the decision reads them: the entities that
    force human review, in subject and body. Sender, names, the other entities and the masked
    texts themselves are left alone; ``mask_messages`` has them all."""
    parts = ("email_subject", "email_body")
    last = max(list(V.PII_PATTERNS).index(e) for e in V.SENSITIVE_ENTITIES)
    work = mask_columns(
        df.withColumn("degenerate", is_degenerate("email_body")),
        {p: (f"__{p}", f"__{p}_pii") for p in parts}, tuple(V.PII_PATTERNS)[:last + 1])
    merged = M.merge_entities(F.col("__email_body_pii"), F.col("__email_subject_pii"), F.lit(0))
    entities = F.when(F.col("degenerate"), M.empty_entities()).otherwise(merged)
    return work.withColumn("pii_entities", entities).drop(
        *[c for p in parts for c in (f"__{p}", f"__{p}_pii")])


def pii_leak(df: DataFrame, draft: str = "draft", out: str = "pii_leak") -> DataFrame:
    """Personal data still readable in a draft, as K=n;K=n (mail addresses tolerated)."""
    kept = F.map_filter(F.col("__leak"), lambda k, _: k.isin(*V.DRAFT_FORBIDDEN_ENTITIES))
    return (
        mask_pii(df, draft, out="__leak_text", entities="__leak")
        .withColumn(out, M.entities_text(kept))
        .drop("__leak_text", "__leak")
    )


def pii_census(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Messages affected and values found, per group and entity."""
    masked = mask_pii(df.select(*by, text), text, out="__t", entities="__e")
    return (
        masked.select(*by, F.explode("__e").alias("entity", "n"))
        .groupBy(*by, "entity")
        .agg(F.count(F.lit(1)).alias("messages"), F.sum("n").cast("long").alias("found"))
    )


def with_excerpt(df: DataFrame, draft: str = "draft", attack_type: str = "attack_type",
                 out: str = "draft_excerpt") -> DataFrame:
    """Start of a draft on one line; adversarial cases keep a longer one."""
    adversarial = text_or_empty(attack_type) != ""
    d = text_or_empty(draft)
    cut = F.when(adversarial, F.substring(d, 1, V.EXCERPT_CHARS_ADVERSARIAL)).otherwise(
        F.substring(d, 1, V.EXCERPT_CHARS))
    return df.withColumn(out, F.translate(cut, "\n", " "))


def cost_usd(tokens_in: Column | str, tokens_out: Column | str,
             price_in: float = V.PRICE_IN_PER_1M,
             price_out: float = V.PRICE_OUT_PER_1M) -> Column:
    tin = F.col(tokens_in) if isinstance(tokens_in, str) else tokens_in
    tout = F.col(tokens_out) if isinstance(tokens_out, str) else tokens_out
    return (tin.cast("double") * price_in + tout.cast("double") * price_out) / 1e6

