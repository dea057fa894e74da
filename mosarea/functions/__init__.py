"""Column expressions and column-set helpers."""
