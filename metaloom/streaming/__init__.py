"""Incremental variants of the batch operators on Structured Streaming."""
