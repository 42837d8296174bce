"""All queries of this folder, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import queries_copies, queries_models, queries_prints, queries_search, queries_shape, queries_tokens

MODULES = [queries_tokens, queries_shape, queries_copies, queries_prints, queries_models, queries_search]


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
