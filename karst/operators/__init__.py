"""Queries over entities, fetches, retrieval."""
