"""Column functions: value semantics, cost models, text forms."""
