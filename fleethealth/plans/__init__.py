"""Registered queries with their SQL, by subject."""

from fleethealth.plans import alarm_queries, model_queries, risk_queries, sensor_queries, stats_queries, text_queries  # noqa: F401
from fleethealth.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
