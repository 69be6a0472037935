"""Structured Streaming forms of the table programs."""
