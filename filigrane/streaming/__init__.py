"""Incremental ingest of filings."""
