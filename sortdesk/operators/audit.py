"""Counts over the review logs, and exports of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import strip, text_or_empty
from ..sources import versions

AUDIT_COLUMNS = (
    "case_id", "created_at", "message_id", "categorie", "priorite", "confiance", "action",
    "decision_reason", "judge_verdict", "cost_usd", "duration_ms", "status",
    "decided_at", "decided_by", "decision", "comment",
)
PROCESSED = ("validated", "edited", "rejected")


def cases_by_status(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def cases_by_reason(cases: DataFrame) -> DataFrame:
    """Most frequent reason first."""
    return (cases.groupBy("decision_reason").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "decision_reason"))


def reason_shares(cases: DataFrame) -> DataFrame:
    """Count of each reason and its share of the most frequent one.

    The window runs over the grouped counts: one row per distinct reason.
    """
    counts = cases.groupBy("decision_reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(
        "share", F.col("n").cast("double") / F.max("n").over(Window.partitionBy()))


def reason_families(cases: DataFrame) -> DataFrame:
    family = F.split_part(text_or_empty("decision_reason"), F.lit(":"), F.lit(1))
    return (cases.groupBy(F.when(family == "", "seuils").otherwise(family).alias("family"))
            .agg(F.count(F.lit(1)).alias("n")))


def decision_totals(state: DataFrame) -> DataFrame:
    """One row: decisions taken, pending cases, processed cases (sent ones left out)."""
    def n(cond: Column) -> Column:
        return F.count_if(cond)
    return state.agg(
        F.coalesce(F.sum("n_decisions"), F.lit(0)).alias("total_decisions"),
        n(F.col("status") == "pending").alias("pending"),
        n(F.col("status").isin(*PROCESSED)).alias("processed"))


def action_tally(results: DataFrame) -> DataFrame:
    """One row: messages per action and how many were escalated."""
    return results.agg(
        *[F.count_if(F.col("action") == a).alias(f"n_{a.lower()}")
          for a in ("AUTO", "HITL", "MANUAL")],
        F.count_if(F.col("action").isin("HITL", "MANUAL")).alias("escalated"))


def audit_export(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every case with its decisions (undecided cases once), 16 columns, in case order.

    Columns the case table lacks come out empty.
    """
    taken = decisions.select("case_id", "seq", "decided_at", "decided_by", "decision", "comment")
    cases = state.select(
        "case_id", *[F.col(c) if c in state.columns else F.lit(None).cast("string").alias(c)
                     for c in AUDIT_COLUMNS[1:12]])
    # A left join cannot split a case with very many decisions; an inner join can. Cases
    # nobody decided are added to it.
    undecided = cases.join(taken.select("case_id").distinct(), "case_id", "left_anti")
    joined = cases.join(taken, "case_id").unionByName(undecided, allowMissingColumns=True)
    return joined.orderBy("case_id", F.asc_nulls_first("seq")).select(*AUDIT_COLUMNS)


def write_audit(export: DataFrame, path: str) -> int:
    """Write the export as CSV and return its row count, observed while it is written.

    Quotes are doubled, as CSV readers expect; a value may hold line breaks, so read it with
    ``multiLine``. An empty export writes no file.
    """
    if export.isEmpty():
        return 0
    seen = Observation()
    export.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").options(
        header=True, escape='"').csv(path)
    return seen.get["n"]


def normal_sender(c: Column | str) -> Column:
    return F.lower(strip(text_or_empty(c)))


def export_gate(cases: DataFrame, allowed: DataFrame, sender: str = "email_from") -> DataFrame:
    """Senders outside the allow-list, each once, sorted. Export only when there are none."""
    keyed = cases.select(F.col(sender), normal_sender(sender).alias("__sender"))
    listed = allowed.select(normal_sender(sender).alias("__sender")).distinct()
    return (keyed.join(listed, "__sender", "left_anti").select(sender).distinct()
            .orderBy(sender))


def export_snapshot(cases: DataFrame, decisions: DataFrame, allowed: DataFrame,
                    path: str) -> bool:
    """Write both logs as one version of a snapshot unless the gate finds a foreign sender.

    Both appear at once; a run that fails in between leaves the former snapshot readable."""
    if not export_gate(cases, allowed).isEmpty():
        return False
    versions.replace(path, {"queue": cases, "decisions": decisions})
    return True


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(cases, decisions) of the newest snapshot, or None before the first."""
    found = versions.folders(spark, path)
    return tuple(spark.read.parquet(*found[name]) for name in ("queue", "decisions")) if found else None


def align_schema(df: DataFrame, contract: StructType, rejects: str | None = None) -> DataFrame:
    """Rows of another schema version in the current one: known columns kept and cast,
    missing ones null, unknown ones dropped.

    A value that cannot be cast becomes null; with ``rejects``, a column of that name lists
    the columns where this happened (empty for a whole row).
    """
    have = set(df.columns)
    cast = [(F.col(f.name).try_cast(f.dataType) if f.name in have
             else F.lit(None).cast(f.dataType)).alias(f.name) for f in contract.fields]
    if rejects is None:
        return df.select(*cast)
    lost = [F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(),
                   F.lit(f.name)) for f in contract.fields if f.name in have]
    return df.select(*cast, F.array_compact(F.array(*lost).cast("array<string>")).alias(rejects))


def load_versions(current: DataFrame, *older: DataFrame, key: str,
                  order: tuple[str, ...] = ()) -> DataFrame:
    """Current rows plus older rows in the current schema; the first row of a key wins.

    Tables go in the order given, rows of one table by ``order``, then by all their columns.
    A row without a key is never a repeat.
    """
    whole = None
    for number, df in enumerate((current, *older)):
        rows = (df if number == 0 else align_schema(df, current.schema)).withColumn(
            "__table", F.lit(number))
        whole = rows if whole is None else whole.unionByName(rows)
    place = F.struct("__table", *order, *[c for c, kind in current.dtypes
                                          if not kind.startswith("map")])
    keyed = whole.where(F.col(key).isNotNull()).withColumn(
        "__n", F.row_number().over(Window.partitionBy(key).orderBy(place))).where("__n = 1")
    return keyed.drop("__n").unionByName(whole.where(F.col(key).isNull())).drop("__table")
