"""Records, schema texts and catalogs."""
