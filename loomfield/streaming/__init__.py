"""Structured Streaming variants of the daily roll-ups."""
