"""Imports every module that registers queries."""

from __future__ import annotations

from millrace.functions import queries as functions  # noqa: F401
from millrace.functions import routines  # noqa: F401
from millrace.operators import aggregation, ddl, dml, joins, relational, subqueries, windows  # noqa: F401
from millrace.plans import frontend, histograms, log_queries, metric_queries, profiles, rules, trace_queries  # noqa: F401
from millrace.registry import ORACLES, QUERIES
from millrace.sources import connectors, ingest  # noqa: F401
from millrace.streaming import queries as streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
