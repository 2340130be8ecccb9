"""All registered queries."""

from stratawave.plans import (  # noqa: F401
    queries_models,
    queries_panel,
    queries_pipeline,
    queries_scenarios,
    queries_series,
)
from stratawave.plans import queries_chain  # noqa: F401  (its table expressions follow those of the others)
from stratawave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
