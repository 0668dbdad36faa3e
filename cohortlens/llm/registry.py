"""The queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, embeddings, html, language, lm_score, mixing, quality, secrets, simhash, suffix

MODULES = (mixing, suffix, language, simhash, html, embeddings, lm_score, quality, bpe, secrets)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
