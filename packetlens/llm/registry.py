"""Queries and DuckDB SQL of the corpus operators."""

from . import bpe, chat, infill, jaccard, licenses, lines, media, mixing, quality, repair, scoring, secrets, urls

MODULES = [bpe, chat, infill, jaccard, licenses, lines, media, mixing, quality, repair, scoring, secrets, urls]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
