"""Column expressions: no operator here reads a table."""
