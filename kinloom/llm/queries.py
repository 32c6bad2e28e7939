"""All queries of the text operators; importing the modules registers them."""

from __future__ import annotations

from kinloom.llm import (  # noqa: F401
    bpe,
    exact,
    language,
    lexical,
    licenses,
    minhash,
    mixing,
    near,
    periods,
    quality,
    sharding,
    spans,
    token_counts,
)
from kinloom.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
