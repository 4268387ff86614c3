"""All registered queries of the library but those of the subpackage for training data."""

from __future__ import annotations

from .plans import account_queries, narration_queries, pattern_queries, risk_queries

PARTS = (account_queries, narration_queries, risk_queries, pattern_queries)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in PARTS for k, v in part.ORACLES.items()}
