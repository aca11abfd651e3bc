"""All core queries and their SQL twins."""

from __future__ import annotations

from verbatrix.plans import records, relational, streams, texts, timestamps, versions
from verbatrix.plans.registry import ORACLE, QUERIES

FLAGSHIP = relational.cohort_metrics

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES", "records", "streams", "texts", "timestamps", "versions"]
