"""Column expressions: names, types, patterns."""
