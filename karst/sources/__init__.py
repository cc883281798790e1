"""Notebooks, response envelopes, web resources."""
