"""Scans, readers and sinks."""
