"""Queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from . import cleaning, embeddings, tokenizers

_PARTS = (cleaning, tokenizers, embeddings)

QUERIES: dict = {name: call for part in _PARTS for name, call in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
