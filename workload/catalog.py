"""All registered queries."""

from __future__ import annotations

from workload import feature_queries, forecast_queries, ledger_queries, model_queries, recurring_queries, uncertainty_queries  # noqa: F401
from workload.feature_queries import flagship  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
