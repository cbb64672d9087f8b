"""All queries over the reference's operators, with their SQL."""

from __future__ import annotations

from . import consensus_queries, format_queries, interval_queries, read_queries, stats_queries, streaming_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "A11_strand_consensus"
