"""Incremental scoring of generation files with Structured Streaming."""
