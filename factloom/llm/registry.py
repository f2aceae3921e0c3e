"""Queries and SQL of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ["sharding", "toxicity", "fingerprint", "ngram_join", "suffix_dedup", "mixing", "warc", "byte_bpe", "pii", "exact_dedup", "sentencepiece_bpe", "resampling", "prefix_trie"]


def _gather(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{m}"), name)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
