"""DataFrame operators: coverage algebra, keyed stores, selection, dedup, triage, digests, provenance."""
