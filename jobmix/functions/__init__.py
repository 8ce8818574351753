"""Column expressions and label rule sets."""
