"""From messages with class, draft and verdict columns to one decision per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators.guardrail import mask_messages, with_sensitive_entities
from ..operators.model_io import approve
from ..operators.policy import Policy
from ..operators.rules import decide, with_input_hits, with_output_hits


def degenerate_defaults(df: DataFrame) -> DataFrame:
    """Class, draft and verdict of a degenerate message, which no model ever saw."""
    fixed = {
        "categorie": V.DEFAULT_CATEGORY, "priorite": V.DEFAULT_PRIORITY, "confiance": 0.0,
        "draft": "", "judge_verdict": "HUMAN_REVIEW",
    }
    fixed["critic_issue"] = "degenerate_input"
    return df.withColumns({
        name: F.when(F.col("degenerate"), F.lit(value)).otherwise(F.col(name))
        for name, value in fixed.items()})


def triage(messages: DataFrame, policy: Policy | Column | None = None,
           texts: bool = True) -> DataFrame:
    """Mask, apply the rules on both sides and decide. No shuffle: works on streams too.

    ``texts=False`` leaves out masked texts, names and the entities no decision reads.
    """
    masked = mask_messages(messages) if texts else with_sensitive_entities(messages)
    work = degenerate_defaults(approve(with_input_hits(masked), policy))
    return decide(with_output_hits(work), policy)
