"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, collocations, embedding_dedup, fingerprint, licenses, line_dedup, mixing, quality, simhash_dedup, toxicity, url_filters

MODULES = (url_filters, chat, toxicity, mixing, licenses, embedding_dedup, fingerprint, bpe, simhash_dedup, line_dedup, collocations, quality)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
