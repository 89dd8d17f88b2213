"""Column expressions: text, vectors, relation semantics."""
