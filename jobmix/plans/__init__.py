"""Result tables (reports), the query registry and the DuckDB oracle SQL."""
