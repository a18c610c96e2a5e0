"""All named queries."""

from __future__ import annotations

from . import q_clean, q_explore, q_index, q_metrics, q_models, q_panel, q_rates, q_resolve, q_scalars, q_sources, q_streams  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
