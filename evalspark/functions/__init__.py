"""Column expressions: text, parsing, metrics."""
