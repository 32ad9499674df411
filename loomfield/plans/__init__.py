"""Composed queries and the query registry."""
