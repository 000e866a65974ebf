"""Queries on the given tables: each pairs a DataFrame job with the SQL that must give the same rows."""

from importlib import import_module

for _area in ("challenges", "staffing", "hiring", "opensource", "operators", "checks", "summary"):
    import_module(f"queries.{_area}")
