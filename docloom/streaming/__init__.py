"""Incremental ingestion from file streams."""
