"""Decision policy: one row of tunables, and its history as of any moment."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import text_or_empty
from ..session import written
from .ordered import carry_forward

TUNABLES = tuple(V.POLICY_DEFAULTS)


@dataclass(frozen=True)
class Policy:
    """Constant policy; the same fields as a policy row."""

    seuil_auto: float = V.POLICY_DEFAULTS["seuil_auto"]
    seuil_hitl: float = V.POLICY_DEFAULTS["seuil_hitl"]
    critic_approve_threshold: float = V.POLICY_DEFAULTS["critic_approve_threshold"]
    hitl_force_categories: str = V.POLICY_DEFAULTS["hitl_force_categories"]
    hitl_force_priorities: str = V.POLICY_DEFAULTS["hitl_force_priorities"]
    sensitive_rules_enabled: bool = V.POLICY_DEFAULTS["sensitive_rules_enabled"]
    output_guardrail_enabled: bool = V.POLICY_DEFAULTS["output_guardrail_enabled"]


def name_list(text: str) -> list[str]:
    return [part.strip().lower() for part in text.split(",") if part.strip()]


def name_list_column(text: Column | str) -> Column:
    """Comma list -> trimmed, lower-case, without blanks."""
    parts = F.transform(F.split(text_or_empty(text), ","), lambda p: F.lower(F.trim(p)))
    return F.filter(parts, lambda p: p != "")


def policy_fields(policy: Policy | Column | None = None) -> dict[str, Column]:
    """Tunables as columns: literals of a constant policy, or fields of a struct column."""
    if isinstance(policy, Column):
        return {name: policy[name] for name in TUNABLES}
    values = asdict(policy or Policy())
    fields = {}
    for name, value in values.items():
        if name.startswith("hitl_force"):
            fields[name] = F.array(*[F.lit(v) for v in name_list(value)]).cast("array<string>")
        else:
            fields[name] = F.lit(value)
    return fields


def policy_rows(overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) policy rows from partial overrides.

    ``overrides`` holds valid_from, updated_by and any subset of the tunables; other
    columns are ignored, a missing or null tunable takes its default (a reset is a row of
    nulls). Refused: a human-review threshold above the automatic one.
    """
    cols = [F.col("valid_from"), F.col("updated_by")]
    for name, default in V.POLICY_DEFAULTS.items():
        given = F.col(name) if name in overrides.columns else F.lit(None)
        if name.startswith("hitl_force"):
            cols.append(name_list_column(
                F.coalesce(given.cast("string"), F.lit(default))).alias(name))
        else:
            kind = "boolean" if isinstance(default, bool) else "double"
            cols.append(F.coalesce(given.cast(kind), F.lit(default)).alias(name))
    rows = overrides.select(*cols)
    ordered = F.col("seuil_hitl") <= F.col("seuil_auto")
    return rows.where(ordered), rows.where(~ordered)


def policy_struct(policy: Policy | None = None, fields: tuple[str, ...] = TUNABLES) -> Column:
    """A constant policy as a struct, to stand in where no history row applies."""
    values = policy_fields(policy)
    return F.struct(*[values[f].alias(f) for f in fields])


#: Seconds of a bucket of the time line: about this many history rows lie in one on average.
ROWS_A_BUCKET, SHORTEST, LONGEST = 4, 1, 86_400


def as_of(facts: DataFrame, ts: str, history: DataFrame, fields: list[str],
          valid_from: str = "valid_from", out: str = "policy",
          width_s: int | None = None) -> DataFrame:
    """Policy in force at ``ts``: the last history row with valid_from <= ts, or null.

    ``fields`` of the history row that wins become a struct; on equal valid_from the
    greatest row (by its fields) wins. A fact without a time gets null.

    The time line is cut into buckets of ``width_s`` seconds, by default as long as a few history
    rows take on average. Validity intervals are cut at bucket edges: a bucket holds the row in
    force when it begins, and its own. Facts meet the intervals of their bucket in an equality
    join with a range test, so a history of any length takes the same way, and adaptive execution
    splits the facts of a busy bucket.
    """
    value = F.struct(F.col(valid_from), *[F.col(f) for f in fields])
    marks = history.where(F.col(valid_from).isNotNull()).groupBy(
        _micros(valid_from).alias("__from")).agg(F.max(value).alias(out))
    marks = written(marks, "policy-marks")
    if width_s is None:
        n, low, high = marks.agg(F.count(F.lit(1)), F.min("__from"), F.max("__from")).first()
        width_s = min(max((high - low) // 1_000_000 * ROWS_A_BUCKET // n, SHORTEST), LONGEST) if n else LONGEST
    bucket = lambda c: F.floor(c / F.lit(width_s * 1_000_000)).cast("long")
    marks = marks.withColumn("__bucket", bucket(F.col("__from")))

    # one row for each bucket that holds facts or history rows: the row in force as it begins
    ends = marks.groupBy("__bucket").agg(F.max_by(out, "__from").alias("__end"),
                                    F.min("__from").alias("__to"))
    asked = facts.select(bucket(_micros(ts)).alias("__bucket")).where("__bucket is not null").distinct()
    line = ends.unionByName(asked.join(ends, "__bucket", "left_anti"), allowMissingColumns=True)
    entering = carry_forward(line, keys=[], order=["__bucket"], block=F.floor(F.col("__bucket") / 4096),
                             value=F.col("__end"), out=out)
    begun = entering.where(F.col(out).isNotNull()).select(
        "__bucket", F.lit(None).cast("long").alias("__from"), "__to", out)
    follows = F.lead("__from").over(Window.partitionBy("__bucket").orderBy("__from"))
    spans = marks.withColumn("__to", follows).select("__bucket", "__from", "__to", out).unionByName(begun)

    at = facts.withColumn("__at", _micros(ts)).withColumn("__in", bucket(F.col("__at")))
    in_force = ((F.col("__in") == F.col("__bucket"))
                & (F.col("__from").isNull() | (F.col("__at") >= F.col("__from")))
                & (F.col("__to").isNull() | (F.col("__at") < F.col("__to"))))
    return at.join(spans, in_force, "left").select(*facts.columns, out)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))
