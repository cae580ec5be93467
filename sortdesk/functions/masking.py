"""Masking of personal data as column expressions.

Every step returns ``struct<text, n>``: the masked text and how many values were
replaced. A text without a candidate costs one pattern scan and is returned as is.

The steps are written as SQL text over named columns (or any SQL expression): one parsed
expression instead of dozens of calls into the JVM while a plan is built.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import ci, col, cs, has_odd_case_sql, sql_text, strip_sql, text_or_empty

# Necessary conditions that are cheaper to look for than the patterns themselves: a card,
# phone or NIR number holds six digits in a row with at most one separator in between.
DIGIT_RUN = r"(?U)\d[\s.\-]?\d[\s.\-]?\d[\s.\-]?\d[\s.\-]?\d[\s.\-]?\d"
_IBAN_START = r"(?U)[Ff][Rr]\d\d"
_LETTERS, _SPACES, _EDGE = r"^\p{L}+$", r"(?U)\s+", r"\b"
_SPECIAL, _QUOTED = r"([\\.\[\]{}()*+?^$|\-])", r"\\$1"
_REPEATED = r"(?U)\[CLIENT_NAME\](?:\s+\[CLIENT_NAME\])+"


def _from_run_start(pattern: str) -> str:
    r"""The same matches as \b[class]+@..., but for a first group, which holds what is skipped.

    Tried at every word boundary, such a pattern runs over a long run of address characters again
    and again. Here only the start of a run (or the end of the last match) is tried, only if an @
    follows the run, and only once from the first boundary in it: all matches that the run allows
    start there, as all end in the same @.
    """
    some, rest = re.fullmatch(r"\\b(\[[^\]]+\])\+(@.+)", pattern).groups()
    return rf"(?:\G|(?<!{some}))(?={some}++@)(?>({some}*?)\b){some}++{rest}"


def _pattern(entity: str) -> str:
    pattern, ignore_case = V.PII_PATTERNS[entity]
    if entity == "EMAIL":
        pattern = _from_run_start(pattern)
    return sql_text(ci(pattern) if ignore_case else cs(pattern))


def _placeholder(name: str, before: str = "") -> str:
    return sql_text(before + "\\" + name)


def _result(text: str, n: str) -> str:
    return f"named_struct('text', {text}, 'n', cast({n} as int))"


def digit_run_sql(text: str) -> str:
    return f"rlike({text}, {sql_text(DIGIT_RUN)})"


def _guard(text: str, entity: str, digit_run: str | None) -> str:
    if entity == "IBAN":
        return f"rlike({text}, {sql_text(_IBAN_START)})"
    if entity == "EMAIL":
        return f"contains({text}, '@')"
    return digit_run or digit_run_sql(text)


def luhn_sql(candidate: str) -> str:
    """Checksum of a 13-19 digit number; separators are ignored."""
    digits = f"regexp_replace({candidate}, '[^0-9]', '')"
    figure = ("if(i % 2 = 0, cast(d as int), "
              "element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(d as int) + 1))")
    total = (f"aggregate(transform(filter(split(reverse({digits}), ''), d -> d <> ''), "
             f"(d, i) -> {figure}), 0, (a, d) -> a + d)")
    return (f"(length({digits}) between {V.CARD_MIN_DIGITS} and {V.CARD_MAX_DIGITS} "
            f"and {total} % 10 = 0)")


def mask_sql(text: str, entity: str, digit_run: str | None = None) -> str:
    """struct<text, n> after masking one kind of personal data in a non-null text.

    ``digit_run`` lets a caller that masks several entities look for it only once.
    """
    pattern = _pattern(entity)
    if entity == "CB":
        found = f"regexp_extract_all({text}, {pattern}, 0)"
        parts = f"arrays_zip(split({text}, {pattern}, -1), {found})"
        shown = (f"case when p.`1` is null then '' when {luhn_sql('p.`1`')} "
                 f"then '{V.PLACEHOLDERS['CB']}' else p.`1` end")
        masked = f"array_join(transform({parts}, p -> concat(p.`0`, {shown})), '')"
        n = f"size(filter({found}, c -> {luhn_sql('c')}))"
    else:
        kept = "$1" if entity == "EMAIL" else ""
        masked = f"regexp_replace({text}, {pattern}, {_placeholder(V.PLACEHOLDERS[entity], kept)})"
        n = f"regexp_count({text}, {pattern})"
    return (f"case when {_guard(text, entity, digit_run)} and rlike({text}, {pattern}) "
            f"then {_result(masked, n)} else {_result(text, '0')} end")


def mask_entity(text: str, entity: str) -> Column:
    """struct<text, n> of a text column (or SQL expression)."""
    return F.expr(mask_sql(f"coalesce({text}, '')", entity))


def mask_iban(text: str) -> Column:
    return mask_entity(text, "IBAN")


def mask_nir(text: str) -> Column:
    return mask_entity(text, "NIR")


def mask_card(text: str) -> Column:
    return mask_entity(text, "CB")


def mask_phone(text: str) -> Column:
    return mask_entity(text, "TEL")


def mask_email(text: str) -> Column:
    return mask_entity(text, "EMAIL")


# --- client name ----------------------------------------------------------------------
def client_name(sender: str) -> Column:
    """Display name of a sender, else the alphabetic parts of the local part, else ''."""
    s, display = f"coalesce({sender}, '')", sql_text(cs(V.DISPLAY_NAME))
    local = strip_sql(f"split_part({s}, '@', 1)")
    tokens = (f"filter(split({local}, {sql_text(V.NAME_TOKEN_SEPARATORS)}), t -> "
              f"rlike(t, {sql_text(_LETTERS)}) "
              f"and length(t) >= {V.NAME_TOKEN_MIN})")
    from_local = f"array_join(transform({tokens}, t -> initcap(t)), ' ')"
    return F.expr(f"case when rlike({s}, {display}) "
                  f"then {strip_sql(f'regexp_extract({s}, {display}, 1)')} "
                  f"else {from_local} end")


def mask_client_name(text: str, name: str) -> Column:
    """struct<text, n>: full name, then each longer token of it, replaced as whole words.

    The pattern differs per row, so rows in which no part of the name occurs are left
    to a plain substring search.
    """
    t, who = f"coalesce({text}, '')", f"coalesce({name}, '')"
    words = (f"concat(array({who}), filter(split({strip_sql(who)}, {sql_text(_SPACES)}), "
             f"w -> length(w) >= {V.NAME_MASK_TOKEN_MIN}))")
    bounded = (f"transform({words}, w -> concat({sql_text(ci(_EDGE))}, "
               f"regexp_replace(w, {sql_text(_SPECIAL)}, {sql_text(_QUOTED)}), "
               f"{sql_text(_EDGE)}))")
    placeholder = _placeholder(V.CLIENT_PLACEHOLDER)
    step = _result(f"regexp_replace(acc.text, p, {placeholder})",
                   "acc.n + regexp_count(acc.text, p)")
    finish = _result(f"regexp_replace(acc.text, {sql_text(_REPEATED)}, {placeholder})", "acc.n")
    folded = (f"aggregate({bounded}, {_result(t, '0')}, (acc, p) -> {step}, "
              f"acc -> {finish})")
    # The collapse of repeated placeholders also touches a text that already holds them.
    touched = (f"exists({words}, w -> contains(lower({t}), lower(w))) "
               f"or {has_odd_case_sql(t)} or {has_odd_case_sql(who)} "
               f"or contains({t}, '{V.CLIENT_PLACEHOLDER}')")
    return F.expr(f"case when {who} <> '' and {t} <> '' and ({touched}) then {folded} "
                  f"else {_result(t, '0')} end")


# --- entity maps ------------------------------------------------------------------------
def empty_entities() -> Column:
    return F.expr("cast(map() as map<string, int>)")


def entity_map(counts: dict[str, str]) -> Column:
    """map<entity, n> holding only the entities that were found; counts are SQL texts."""
    found = ", ".join(f"if({n} > 0, named_struct('k', '{k}', 'v', cast({n} as int)), null)"
                      for k, n in counts.items())
    return F.expr(f"map_from_entries(array_compact(array({found})))")


def merge_entities(body: Column, subject: Column, n_name: Column) -> Column:
    """Entities of both parts added up, plus the client name when it was found."""
    both = F.map_zip_with(
        body, subject, lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return F.when(
        n_name > 0,
        F.map_concat(both, F.create_map(F.lit(V.NAME_ENTITY), n_name.cast("int"))),
    ).otherwise(both)


def entities_total(entities: Column | str) -> Column:
    return F.aggregate(F.map_values(col(entities)), F.lit(0), lambda a, v: a + v)


def entities_text(entities: Column | str) -> Column:
    """K=n;K=n in the order of the map."""
    return F.array_join(
        F.transform(F.map_entries(col(entities)),
                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))),
        ";")


# --- reinjection --------------------------------------------------------------------------
def reinjection_map(draft: Column | str, name: Column | str) -> Column:
    """{[CLIENT_NAME]: name} when a name exists and the draft holds the placeholder."""
    wanted = (text_or_empty(name) != "") & text_or_empty(draft).contains(V.CLIENT_PLACEHOLDER)
    return F.when(
        wanted, F.create_map(F.lit(V.CLIENT_PLACEHOLDER), col(name))
    ).otherwise(F.expr("cast(map() as map<string, string>)"))


def reinject(draft: Column | str, replacements: Column | str) -> Column:
    """Draft with every placeholder of the map replaced by its value."""
    return F.aggregate(
        F.map_entries(col(replacements)), text_or_empty(draft),
        lambda acc, e: F.replace(acc, e["key"], e["value"]))
