"""All queries of the core, gathered from their modules."""

from __future__ import annotations

from gleanwork.plans import queries_build, queries_eval, queries_identity, queries_made, queries_nested, queries_sampling, queries_text

_PARTS = (queries_nested, queries_eval, queries_sampling, queries_identity, queries_text, queries_made, queries_build)

QUERIES = {k: v for p in _PARTS for k, v in p.query.queries.items()}
SQL = {k: v for p in _PARTS for k, v in p.query.sql.items()}
