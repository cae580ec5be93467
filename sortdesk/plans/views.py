"""Triage input derived from the given tables, one row per source row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread_small
from . import sample_values as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of long texts, spread over the cores when it is one small file."""
    return spread_small(table(spark, sf_dir, name), key)


def pick(values: tuple[str, ...], index: Column) -> Column:
    """values[index % n]"""
    lits = F.array(*[F.lit(v) for v in values])
    return F.element_at(lits, (index % len(values)).cast("int") + 1)


def seconds_after_start(n: Column) -> Column:
    zero = F.lit(0)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(zero, zero, zero, n.cast("decimal(18,6)"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from(text_table(spark, sf_dir, "documents", "doc_id"))


def messages_from(documents: DataFrame) -> DataFrame:
    """Customer messages from documents: whole text plus one sample line."""
    i = F.col("doc_id")
    who = pick(S.DISPLAY_NAMES, i)
    dotted = F.lower(F.replace(who, F.lit(" "), F.lit(".")))
    n = F.col("doc_id").cast("string")
    sender = (
        F.when(i % 6 == 0, F.concat(F.lit('"'), who, F.lit('" <'), dotted,
                                    F.lit("@exemple.fr>")))
        .when(i % 6 == 1, F.concat(dotted, F.lit("@exemple.fr")))
        .when(i % 6 == 2, F.concat(F.lit("client"), n, F.lit("@exemple.fr")))
        .when(i % 6 == 3, F.lit("service@exemple.fr"))
        .when(i % 6 == 4, F.lit("no-reply@exemple.fr")))
    body = F.when(i % 37 == 0, F.lit("..")).otherwise(
        F.concat(F.col("text"), F.lit("\n"), pick(S.SNIPPETS, i)))
    twin = i - F.when(i % 10 == 9, 1).otherwise(0)
    return documents.select(
        "doc_id", "lang", "source",
        F.when(i % 23 != 0, F.concat(F.lit("M"), twin.cast("string"))).alias("message_id"),
        F.when((i % 23 == 0) & (i % 2 == 0), F.concat(F.lit("J"), n)).alias("job_id"),
        sender.alias("email_from"),
        pick(S.SUBJECTS, i).alias("email_subject"),
        body.alias("email_body"),
        seconds_after_start(i * 97).alias("received_at"))


def classified(df: DataFrame) -> DataFrame:
    """Add classifier columns computed from doc_id."""
    i = F.col("doc_id")
    return (
        df.withColumn("categorie", pick(S.CATEGORY_CYCLE, i))
        .withColumn("priorite", pick(S.PRIORITY_CYCLE, F.floor(i / 9)))
        .withColumn("confiance", ((i * 37) % 101).cast("double") / 100)
    )


def drafted(df: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    return df.withColumn(
        "draft", F.when(i % 41 == 0, F.lit("")).otherwise(pick(S.REPLIES, i)))


def judged(df: DataFrame) -> DataFrame:
    """Add four scores and a verdict; the verdict of every 13th row contradicts them."""
    i = F.col("doc_id")
    out = df
    for n, name in enumerate(("pertinence", "ton", "conformite", "factualite"), start=1):
        out = out.withColumn(name, (1 + (i * n + F.floor(i / 5)) % 5).cast("int"))
    lowest = F.least("pertinence", "ton", "conformite", "factualite")
    by_score = (F.when(lowest >= 4, "AUTO_SEND").when(lowest == 3, "HUMAN_REVIEW")
                .otherwise("REJECT"))
    flipped = F.when(lowest >= 4, "REJECT").otherwise("AUTO_SEND")
    # Most rows of the given ids would be rejected, so two of three are lifted.
    out = out.withColumn("judge_verdict", F.when(i % 13 == 0, flipped).otherwise(by_score))
    return out


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft attempts: the assistant turns of a conversation, in turn order."""
    n = F.length("text")
    return table(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("attempt"), F.col("text").alias("draft"),
        (n % 3 == 0).alias("critic_approved"),
        n.cast("long").alias("tokens_out"), (n * 2).cast("long").alias("tokens_in"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalated cases, one per customer."""
    i = F.col("c_custkey")
    sender = F.concat(F.lit('"'), F.col("c_name"), F.lit('" <'), F.lower("c_mktsegment"),
                      F.lit("."), i.cast("string"), F.lit("@exemple.fr>"))
    return table(spark, sf_dir, "customer").select(
        i.alias("case_id"),
        seconds_after_start(i % 1000 * 60).alias("created_at"),
        F.concat(F.lit("M"), i.cast("string")).alias("message_id"),
        F.lit(None).cast("string").alias("job_id"),
        sender.alias("email_from"),
        F.concat(F.lit("Dossier "), F.col("c_name")).alias("subject_raw"),
        F.when(i % 5 != 0, F.concat(F.lit("Dossier "), F.lower("c_mktsegment")))
        .otherwise("").alias("subject_masked"),
        pick(S.CATEGORY_CYCLE, i).alias("categorie"),
        pick(S.PRIORITY_CYCLE, i).alias("priorite"),
        (((i * 37) % 101).cast("double") / 100).alias("confiance"),
        pick(S.CASE_REASONS, i).alias("decision_reason"),
        pick(S.REPLIES, i).alias("draft"),
        F.col("c_acctbal").alias("amount"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer and robot commands from events; every fiftieth names an unknown case.

    Some clicks confirm a sending, the others and all views are no known decision.
    """
    e = F.col("event_id")
    kind = F.col("event_type")
    command = (F.when(kind == "purchase", "validated").when(kind == "signup", "edited")
               .when(kind == "error", "rejected")
               .when((kind == "click") & (e % 60 < 2), "mark_sent")
               .otherwise("postponed"))
    edit = F.when(e % 17 == 0, F.lit("  ")).otherwise(pick(S.EDIT_TEXTS, F.floor(e / 3)))
    return table(spark, sf_dir, "events").select(
        e.alias("seq"), F.col("ts").cast("timestamp_ntz").alias("at"),
        (F.col("user_id") + F.when(e % 50 == 0, 1000000).otherwise(0)).alias("case_id"),
        command.alias("command"),
        F.when(kind == "signup", edit).otherwise("").alias("final_draft"),
        F.concat(F.lit("agent"), (e % 7).cast("string")).alias("decided_by"),
        F.concat(F.lit("note "), (e % 10).cast("string")).alias("comment"))


def policy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial policy overrides: every signup event changes the policy."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").where(F.col("event_type") == "signup").select(
        F.col("ts").cast("timestamp_ntz").alias("valid_from"),
        F.concat(F.lit("agent"), (e % 7).cast("string")).alias("updated_by"),
        F.when(e % 5 != 0, 0.80 + (e % 3).cast("double") * 0.05).alias("seuil_auto"),
        F.when(e % 7 != 0, 0.60 + (e % 4).cast("double") * 0.10).alias("seuil_hitl"),
        F.when(e % 4 == 0, F.lit(" Spam, ,AUTRE")).alias("hitl_force_categories"),
        F.when(e % 6 == 0, e % 12 == 0).alias("sensitive_rules_enabled"),
        e.alias("ignored_column"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_from(table(spark, sf_dir, "events"))


def calls_from(events: DataFrame) -> DataFrame:
    """Run metrics from events."""
    e = F.col("event_id")
    return events.select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id",
        pick(("AUTO", "HITL", "MANUAL"), e).alias("action"),
        (e % 2000).alias("tokens_in"), (e % 500).alias("tokens_out"),
        (e % 6).alias("llm_calls"), (e % 4).alias("rag_hits"),
        ((e * 7919) % 9000).alias("latency_ms"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from(table(spark, sf_dir, "events"))


def requests_from(events: DataFrame) -> DataFrame:
    """Incoming requests from events; every nineteenth has no key."""
    e = F.col("event_id")
    return events.select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(e % 19 != 0, F.col("user_id").cast("string")).alias("request_key"),
        F.col("user_id").alias("session_id"),
        (F.col("event_type") != "error").alias("succeeded"),
        F.repeat(F.lit("x"), (e % 2100).cast("int")).alias("body"))


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected outcome of labelled messages."""
    i = F.col("doc_id")
    risky = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(risky, "HITL").otherwise("AUTO_SEND").alias("expected_verdict"),
        pick(S.CATEGORY_CYCLE, i + F.when(i % 8 == 0, 1).otherwise(0))
        .alias("expected_categorie"),
        pick(S.PRIORITY_CYCLE, F.floor(i / 9) + F.when(i % 11 == 0, 1).otherwise(0))
        .alias("expected_priorite"))
