"""Operators on item tables."""
