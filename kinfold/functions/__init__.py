"""Column expressions and skew-safe ranking helpers."""
