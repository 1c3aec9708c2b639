"""All queries of this subpackage and of the corpus pipeline, with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "pieces", "url_reputation", "chat_format", "mixing", "token_counts", "ngram_join", "exact_dedup", "vector_search", "licenses", "alignment", "collocations", "simhash")


def _modules():
    return [import_module(f"tallyforge.llm.{name}") for name in MODULES]


def queries() -> dict:
    import corpus_pipeline

    found = {name: query for module in _modules() for name, query in module.QUERIES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracles() -> dict:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
