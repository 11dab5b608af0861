"""Column expressions: geometry, hashing, vectors, text."""
