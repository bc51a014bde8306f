"""Incremental forms of the upserts."""
