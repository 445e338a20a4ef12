"""All queries of this subpackage, and the pipeline's, with the SQL that must give the same rows."""

from __future__ import annotations

import corpus_pipeline
from vitrine.llm import q_native, q_phrases, q_texts

REGISTRIES = (q_native.R, q_texts.R, q_phrases.R)


def queries() -> dict:
    return {name: fn for r in REGISTRIES for name, fn in r.queries.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in REGISTRIES for name, sql in r.sql.items()}
