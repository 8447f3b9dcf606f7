"""Incremental upkeep by Structured Streaming."""
