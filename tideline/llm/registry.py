"""Queries of the corpus operators and of the pipeline over them."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

MODULES = ("suffix_dedup", "quality_rules", "packing", "chat_format", "simhash", "secret_scan", "decontaminate", "substring_dedup", "quality_classifier", "pii", "tokenizer_alignment", "mixing", "fill_middle")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"tideline.llm.{name}"), attribute)
    return out


def queries() -> dict:
    return _merged("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES") | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
