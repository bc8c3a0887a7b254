"""Names of the registered queries, with their DuckDB oracles."""

from __future__ import annotations

from paperloom.plans import control, dialogue, documents, operations, parsing, store
from paperloom.plans.base import Query

FLAGSHIP = "doc_quality_profile"

_ALL = documents.QUERIES | dialogue.QUERIES | parsing.QUERIES | store.QUERIES | control.QUERIES | operations.QUERIES


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
