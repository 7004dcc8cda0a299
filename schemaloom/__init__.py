"""schemaloom: schema analytics over semi-structured data, as DataFrame and SQL queries."""
