"""Scans and sinks: recordings, text tables, catalogs of files."""
