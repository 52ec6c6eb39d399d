"""All registered queries and their oracles."""

from __future__ import annotations

from tidemark.plans import queries_claims, queries_coverage, queries_files, queries_flow, queries_json, queries_library, queries_more, queries_render, queries_streams, queries_text  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
