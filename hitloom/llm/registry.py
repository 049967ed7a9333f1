"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, filter_audit, lang_id, licenses, mixing, near_dup, quality_model, quality_rules, repeats, source_audit, token_store

_MODULES = (bpe, licenses, chat, token_store, ann, quality_rules, quality_model, near_dup, mixing, lang_id, repeats, source_audit, filter_audit)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: query for m in _MODULES for name, query in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
