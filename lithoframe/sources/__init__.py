"""Scans, catalog discovery and sinks."""
