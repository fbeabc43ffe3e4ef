"""Names of this subpackage's queries and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import queries_mining, queries_models, queries_text


def queries() -> dict:
    return queries_text.QUERIES | queries_models.QUERIES | queries_mining.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return queries_text.ORACLES | queries_models.ORACLES | queries_mining.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
