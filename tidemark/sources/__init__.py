"""Paged source, document extractors and JSON scans."""
