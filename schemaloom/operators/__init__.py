"""Relational operators over field catalogs."""
