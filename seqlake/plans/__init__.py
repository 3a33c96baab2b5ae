"""Registered queries over the driver tables (one module per area)."""

from seqlake.plans import convert_plans, corpus_plans, encoding_plans, events_plans, packing_plans, scoring_plans, stats_plans, stream_plans, training_plans  # noqa: F401
from seqlake.plans.registry import oracle_sql, queries

__all__ = ["queries", "oracle_sql"]
