"""Column expressions: hashing, URLs, names, text normalisation, statistics."""
