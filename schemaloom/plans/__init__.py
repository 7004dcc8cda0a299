"""Query texts, rendering and migration reports."""
