"""Structured Streaming forms of the batch reports (incremental refresh)."""
