"""Structured Streaming jobs over field catalogs."""
