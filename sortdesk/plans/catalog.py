"""All registered queries and their check statements."""

from __future__ import annotations

from . import (catalog_cases, catalog_evaluation, catalog_files, catalog_guardrail,
               catalog_retrieval, catalog_streaming)

_GROUPS = (catalog_guardrail, catalog_cases, catalog_retrieval, catalog_evaluation,
           catalog_streaming, catalog_files)


def queries() -> dict:
    return {name: fn for group in _GROUPS for name, fn in group.QUERIES.items()}


def checks() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.ORACLE.items()}
