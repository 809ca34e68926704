"""Query registry and DuckDB oracle text."""
