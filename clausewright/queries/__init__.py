"""Queries over the driver's tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from clausewright.queries import cases, clauses, feedback, layout, matching, sentences, texts, varied, varied_documents

_MODULES = (matching, feedback, texts, layout, clauses, cases, sentences, varied, varied_documents)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
