"""Replaying labelled messages: draft assertions, per-message outcome, summary figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import is_blank, text_or_empty
from ..session import written


# --- drafts --------------------------------------------------------------------------------
def check_drafts(df: DataFrame, checks: DataFrame, key: str, draft: str = "draft") -> DataFrame:
    """Add check_ok and check_failed from per-case assertions.

    ``checks`` holds key, forbidden and required pattern arrays, must_be_empty. Patterns
    ignore case. A message without assertions passes.
    """
    d = text_or_empty(draft)

    def matches(pattern: Column) -> Column:
        return F.rlike(d, F.concat(F.lit("(?iU)"), pattern))

    none = F.array().cast("array<string>")
    banned = F.transform(F.filter(F.coalesce("forbidden", none), matches),
                         lambda p: F.concat(F.lit("interdit:"), p))
    lacking = F.transform(F.filter(F.coalesce("required", none), lambda p: ~matches(p)),
                          lambda p: F.concat(F.lit("manquant:"), p))
    not_empty = F.when(F.coalesce("must_be_empty", F.lit(False)) & ~is_blank(draft),
                       F.array(F.lit("draft_non_vide"))).otherwise(none)
    spec = checks.select(key, "forbidden", "required", "must_be_empty")
    return (
        df.join(spec, key, "left")
        .withColumn("check_failed", F.array_join(F.concat(not_empty, banned, lacking), ";"))
        .withColumn("check_ok", F.col("check_failed") == "")
        .drop("forbidden", "required", "must_be_empty")
    )


def with_severity(df: DataFrame) -> DataFrame:
    """ok, critique (a faulty draft was sent) or contenu_intercepte (it was held back)."""
    return df.withColumn(
        "check_severity",
        F.when(F.col("check_ok"), "ok").when(F.col("action") == "AUTO", "critique")
        .otherwise("contenu_intercepte"))


# --- outcome per message -------------------------------------------------------------------
def evaluate_rows(results: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Replayed results next to their labels; results without a label are left out."""
    got_category = F.coalesce("categorie", F.lit(V.DEFAULT_CATEGORY))
    got_priority = F.coalesce("priorite", F.lit(V.DEFAULT_PRIORITY))
    got = F.when(F.col("action") == "AUTO", "AUTO_SEND").otherwise("HITL")
    return results.join(expected, key).withColumns({
        "cat_ok": F.col("expected_categorie") == got_category,
        "pri_ok": F.col("expected_priorite") == got_priority,
        "got_verdict": got,
        "verdict_ok": F.col("expected_verdict") == got,
        "faux_auto_send": (F.col("expected_verdict") == "HITL") & (F.col("action") == "AUTO"),
    })


# --- figures -------------------------------------------------------------------------------
def floored_rank(df: DataFrame, value: str, by: list[str], share: float = 0.95,
                 out: str = "p95") -> DataFrame:
    """Value at 1-based position floor(share * n) of the sorted values; 0 for n < 2.

    Whole numbers are counted first, so the ordered window sees one row per distinct value
    (whole milliseconds) and never the messages themselves. Of other numbers, which have as many
    distinct ones as rows, the rank is selected: see ``_selected_rank``.
    """
    if dict(df.dtypes)[value] not in _WHOLE:
        return _selected_rank(df, value, by, share, out)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum("__c").over(group)
    placed = counts.withColumns({
        "__n": n, "__upto": F.sum("__c").over(upto),
        "__rank": F.floor(F.lit(share) * n)})
    hit = F.when(F.col("__upto") >= F.col("__rank"), F.col(value))
    return placed.groupBy(*by).agg(
        F.when(F.max("__n") < 2, F.lit(0)).otherwise(F.min(hit)).alias(out))


_WHOLE = ("tinyint", "smallint", "int", "bigint")
#: Ranges that a group is cut into, and rows of a group that are sorted in one task.
RANGES, SORTED_ROWS = 64, 10_000


def _selected_rank(df: DataFrame, value: str, by: list[str], share: float, out: str) -> DataFrame:
    """The floored rank of numbers of any kind, without sorting a group.

    Approximate quantiles cut each group into ranges, and each of the cutting values is a range of
    its own. The counts of the ranges say which one holds the rank; only its rows are looked at
    again, until they are few, or equal. A null is no value; NaN is above all others.
    """
    group = F.struct(*by) if by else F.lit(0)
    rows = written(df.where(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).alias("v")),
                   "values")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    wanted = written(sizes.withColumn("rank", F.greatest(F.floor(F.lit(share) * F.col("n")), F.lit(1))),
                     "ranks")
    cuts = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    while not rows.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("a"), F.max("v").alias("b")
                                    ).where(F.col("c") > SORTED_ROWS).where("a < b").isEmpty():
        edges = rows.groupBy("g").agg(F.percentile_approx("v", cuts, 1000).alias("e"))
        edges = written(edges.withColumn("e", F.array_distinct("e")), "edges")
        below = F.size(F.filter("e", lambda e: e < F.col("v")))
        placed = written(rows.join(edges, "g").select(
            "g", "v", (2 * below + F.array_contains("e", F.col("v")).cast("int")).alias("r")), "ranges")
        counted = placed.groupBy("g", "r").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy("g").orderBy("r"))   # RANGES * 2 rows of a group
        holding = counted.withColumn("upto", upto).join(wanted, "g").where(
            (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        holding = written(holding.select("g", "r", "n", (F.col("rank") - F.col("upto") + F.col("c"))
                                         .alias("rank")), "holding")
        rows = written(placed.join(holding.select("g", "r"), ["g", "r"]).select("g", "v"), "values")
        wanted = holding.drop("r")
    # few rows of a group, or equal ones, of which one is as good as another
    counted = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy("g").orderBy("v")))
    found = upto.join(wanted, "g").where("upto >= rank").groupBy("g").agg(
        F.min("v").alias("v"), F.max("n").alias("n"))
    return found.select(*[F.col("g")[c].alias(c) for c in by],
                        F.when(F.col("n") < 2, F.lit(0)).otherwise(F.col("v")).alias(out))


def _check_whole(df: DataFrame, value: str) -> None:
    if dict(df.dtypes)[value] not in _WHOLE:
        raise ValueError(f"{value} must hold whole numbers")


def _percent(condition: Column) -> Column:
    return 100.0 * F.count_if(condition) / F.count(F.lit(1))


def _summed(rows: DataFrame, by: list[str], value: str, counts: dict[str, Column],
            sums: dict[str, Column], share: float = 0.95) -> DataFrame:
    """Per group: n, the counted conditions, the sums, and the floored rank of ``value``.

    Everything is combined per distinct value first. The ordered window and the final sums
    both work on those rows, so the input is read and shuffled once.
    """
    _check_whole(rows, value)
    first = rows.groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(c).alias(name) for name, c in counts.items()],
        *[F.sum(c).alias(name) for name, c in sums.items()])
    group = Window.partitionBy(*by)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = first.withColumns({
        "__n": F.sum("n").over(group), "__upto": F.sum("n").over(upto)})
    rank = F.floor(F.lit(share) * F.col("__n"))
    hit = F.when(F.col("__upto") >= rank, F.col(value))
    return placed.groupBy(*by).agg(
        *[F.sum(name).alias(name) for name in ("n", *counts, *sums)],
        F.when(F.max("__n") < 2, F.lit(0)).otherwise(F.min(hit)).alias("__rank_value"))


def evaluate_summary(rows: DataFrame, by: list[str] | None = None,
                     auto_threshold: float = V.POLICY_DEFAULTS["seuil_auto"]) -> DataFrame:
    """One row of figures, or one per group of ``by`` (prompt versions, sources, ...).

    Means of latency and tokens are truncated to whole numbers, percentages are not
    rounded. The counterfactual shows the false automatic sends without the rule table.
    """
    by = by or []
    must_review = F.col("expected_verdict") == "HITL"
    judge_sends = F.col("judge_verdict") == "AUTO_SEND"
    sums = _summed(rows, by, "latency_ms", {
        "must_review": must_review,
        "faux_auto": F.col("faux_auto_send"),
        "cat": F.col("cat_ok"), "pri": F.col("pri_ok"), "verdict": F.col("verdict_ok"),
        "escalated": F.col("action").isin("HITL", "MANUAL"),
        "zero_llm": F.col("llm_calls") == 0,
        "critical": F.col("check_severity") == "critique",
        "held_back": F.col("check_severity") == "contenu_intercepte",
        "leaks": F.col("pii_leak") != "",
        "without_rules": must_review & judge_sends & (F.col("confiance") >= auto_threshold),
        "judge_sends": judge_sends,
    }, {
        "latency": F.col("latency_ms"), "cost": F.col("cost_usd"),
        "tokens": F.col("tokens_in") + F.col("tokens_out"), "hits": F.col("rag_hits"),
    })
    n = F.col("n")
    reviewed = F.greatest(F.col("must_review"), F.lit(1))

    def percent(name: str, of: Column = n) -> Column:
        return F.lit(100.0) * F.col(name) / of

    def mean(name: str) -> Column:
        return F.col(name).cast("double") / n

    return sums.select(
        *by, n.alias("n_emails"),
        percent("faux_auto", reviewed).alias("taux_faux_auto_send_pct"),
        percent("cat").alias("precision_categorie_pct"),
        percent("pri").alias("precision_priorite_pct"),
        percent("verdict").alias("concordance_verdict_pct"),
        percent("escalated").alias("taux_escalade_pct"),
        mean("latency").cast("long").alias("latence_moyenne_ms"),
        F.col("__rank_value").alias("latence_p95_ms"),
        mean("cost").alias("cout_moyen_usd"), F.col("cost").alias("cout_total_usd"),
        mean("tokens").cast("long").alias("tokens_moyens"),
        F.col("zero_llm").alias("emails_zero_llm"), mean("hits").alias("rag_hits_moyens"),
        F.col("critical").alias("brouillons_fautifs_envoyes"),
        F.col("held_back").alias("brouillons_fautifs_interceptes"),
        F.col("leaks").alias("fuites_pii"),
        percent("without_rules", reviewed).alias("faux_auto_send_sans_regles_pct"),
        percent("judge_sends").alias("judge_auto_send_pct"))


def offenders(rows: DataFrame, key: str) -> DataFrame:
    """(kind, id) of the messages behind the alarming figures: a table, however long."""
    kinds = F.array_compact(F.array(
        F.when(F.col("faux_auto_send"), "faux_auto_send"),
        F.when(F.col("check_severity") == "critique", "brouillon_fautif_envoye"),
        F.when(F.col("check_severity") == "contenu_intercepte", "brouillon_fautif_intercepte"),
        F.when(F.col("pii_leak") != "", "fuite_pii")))
    return rows.select(F.explode(kinds).alias("kind"), F.col(key).alias("id"))


def run_figures(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Escalation rate, latency, tokens, retrieval hits and calls without a model."""
    by = by or []
    figures = calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        _percent(F.col("action").isin("HITL", "MANUAL")).alias("escalation_pct"),
        F.avg("latency_ms").cast("long").alias("latency_mean_ms"),
        F.avg(F.col("tokens_in") + F.col("tokens_out")).cast("long").alias("tokens_mean"),
        F.avg("rag_hits").alias("rag_hits_mean"),
        F.count_if(F.col("llm_calls") == 0).alias("without_model"))
    return figures


# --- stages --------------------------------------------------------------------------------
def stage_latency(trace: DataFrame, agent: str = "agent") -> DataFrame:
    """Runs, failures, mean and p95 duration per stage of a (long) trace table."""
    sums = _summed(trace, [agent], "duration_ms", {"failures": ~F.col("success")},
                   {"total_ms": F.col("duration_ms")})
    return sums.select(
        agent, F.col("n").alias("runs"), "failures",
        (F.col("total_ms").cast("double") / F.col("n")).alias("mean_ms"),
        F.col("__rank_value").alias("p95_ms"))


def message_trace(trace: DataFrame, key: str, order: str) -> DataFrame:
    """One row per message: its stages in order as ``trace``, the texts of failed ones as
    ``errors``. A message passes a dozen stages at most, so the arrays stay small; the table
    is not sorted as a whole."""
    error = F.when(~F.col("success"), F.concat(
        F.lit("["), F.col("agent"), F.lit("] "), text_or_empty("note")))
    step = F.struct(F.col(order), "agent", "duration_ms", "success", text_or_empty("note").alias("note"),
                    error.alias("error"))
    steps = trace.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("__steps"))
    return steps.select(
        key, F.transform("__steps", lambda s: s.dropFields("error")).alias("trace"),
        F.filter(F.transform("__steps", lambda s: s["error"]), lambda e: e.isNotNull())
        .alias("errors"))
