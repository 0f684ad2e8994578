"""All queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import queries_clicks, queries_join, queries_manifest, queries_models, queries_pages, queries_secrets, queries_text, queries_tokens

_MODULES = (queries_text, queries_tokens, queries_models, queries_pages, queries_join, queries_manifest, queries_secrets, queries_clicks)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
