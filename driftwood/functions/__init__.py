"""Column expressions: derived features, tail probabilities, name helpers."""
