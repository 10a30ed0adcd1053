"""Structured Streaming forms of incremental behaviour."""
