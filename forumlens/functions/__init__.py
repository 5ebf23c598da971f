"""Column-expression helpers (scalar functions, tokenization, statistics)."""
