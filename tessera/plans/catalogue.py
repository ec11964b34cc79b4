"""All registered queries of the panel side, and their SQL."""

from __future__ import annotations

from tessera.plans import candle_queries, desk_queries, formula_queries, market_queries, more_queries, pattern_queries, research_queries, row_queries  # noqa: F401  each registers its queries
from tessera.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
