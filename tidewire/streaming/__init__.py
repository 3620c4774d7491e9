"""Structured Streaming counterparts of the incremental operators."""
