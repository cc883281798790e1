"""Lookups, text, chemistry."""
