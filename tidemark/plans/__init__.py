"""Registered queries, their SQL oracles, and whole-flow orchestration."""
