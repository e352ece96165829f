"""Scans and sinks: source files, sidecars, and the tables that a run leaves behind."""
