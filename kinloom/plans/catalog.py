"""All registered queries."""

from __future__ import annotations

from kinloom.plans import (  # noqa: F401  (importing registers the queries)
    kin_queries,
    layout_queries,
    live_queries,
    pair_queries,
    panel_queries,
    rule_queries,
    time_queries,
)
from kinloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
