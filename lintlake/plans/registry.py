"""All registered queries of the engine's own operators."""

from __future__ import annotations

from lintlake.plans import (
    accounting_queries,
    compile_queries,
    event_queries,
    planner_queries,
    report_queries,
    response_queries,
    review_queries,
    risk_queries,
    source_queries,
    stored_queries,
    text_queries,
    token_queries,
)

_MODULES = (
    review_queries,
    accounting_queries,
    text_queries,
    report_queries,
    event_queries,
    compile_queries,
    risk_queries,
    planner_queries,
    source_queries,
    stored_queries,
    response_queries,
    token_queries,
)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
