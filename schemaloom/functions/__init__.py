"""Fixed values, type names and column expressions."""
