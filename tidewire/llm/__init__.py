"""Operators of a training-data pipeline: deduplication, scoring, scanning, extraction and token storage.

Nothing else in the library imports this package.
"""
