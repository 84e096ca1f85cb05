"""Operators for large training-data pipelines: duplicates, counts, splits, text forms, tokens, mixing, sentences."""
