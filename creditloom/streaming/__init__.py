"""Incremental and streaming forms of the daily jobs."""
