"""Catalogs, plans, planners."""
