"""Column expressions: text in, column out; no shuffle."""
