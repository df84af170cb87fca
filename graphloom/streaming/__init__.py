"""Incremental ingest of scan records."""
