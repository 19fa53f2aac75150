"""Named queries of the engine's own operators and their DuckDB twins."""

from __future__ import annotations

from . import extras, governance, graphs, kept, notes, reports, retrieval, texts

_MODULES = (retrieval, texts, graphs, notes, governance, reports, extras, kept)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
