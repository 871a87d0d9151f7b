"""All queries of the reference-style operators, and their SQL."""

from __future__ import annotations

from . import moment_queries, record_queries, transcript_queries
from .moment_queries import top_moments

QUERIES = transcript_queries.R.queries | moment_queries.R.queries | record_queries.R.queries
ORACLES = transcript_queries.R.sql | moment_queries.R.sql | record_queries.R.sql
__all__ = ["ORACLES", "QUERIES", "top_moments"]
