"""Incremental loads with Structured Streaming."""
