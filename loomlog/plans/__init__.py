"""Flows composed from the operators: ingest, store, archive."""
