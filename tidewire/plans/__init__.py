"""Registered queries over the base tables, each with the same question in SQL."""
