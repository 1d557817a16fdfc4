"""Column expressions: text, numbers, finance, vectors."""
