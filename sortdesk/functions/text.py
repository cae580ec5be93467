"""Text helpers shared by the operators (columns in, columns out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ci(pattern: str) -> str:
    """Ignore case, with Unicode letters, digits, spaces and boundaries."""
    return "(?iU)" + pattern


def cs(pattern: str) -> str:
    """Case-sensitive, with Unicode classes."""
    return "(?U)" + pattern


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col(c), cs(r"^\s+|\s+$"), "")


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(col(c).rlike(cs(r"\S")), F.lit(False))


def stripped_length_below(c: Column | str, n: int) -> Column:
    """length(strip(c)) < n, without a walk through the rest of a long text."""
    text = text_or_empty(c)
    return ~text.rlike(cs(r"\S[\s\S]{%d,}?\S" % (n - 2))) if n > 1 else is_blank(text)


# Letters that equal an ASCII letter when case is ignored but are not lowered to it.
_ODD_CASE = ("\u017f", "\u212a", "\u0131", "\u0130")


def has_odd_case_sql(text: str) -> str:
    """Texts for which a search in lower(text) may miss what (?i) finds."""
    return "(" + " or ".join(f"contains({text}, '{c}')" for c in _ODD_CASE) + ")"


def sql_text(value: str) -> str:
    """A text as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, {sql_text(cs(r'^\s+|\s+$'))}, '')"


LABEL_SEPARATOR = "+"


def labels(joined: Column | str) -> Column:
    """The a+b+c text as an array; '' is the empty array."""
    j = col(joined)
    return F.when(j == "", F.array().cast("array<string>")).otherwise(
        F.split(j, r"\+"))
