"""Scans, text formats and sinks."""
