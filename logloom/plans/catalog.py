"""All registered queries."""

from __future__ import annotations

from logloom.plans import (  # noqa: F401
    q_anomaly, q_forecast, q_functions, q_logs, q_models, q_streams, q_templates, q_threats)
from logloom.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
