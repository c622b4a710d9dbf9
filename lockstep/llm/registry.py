"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import ann, bpe, chat, flac, jaccard_join, packing, sharding, substring_dedup, toxicity, url_filter

MODULES = [chat, flac, sharding, substring_dedup, ann, bpe, packing, jaccard_join, toxicity, url_filter]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
