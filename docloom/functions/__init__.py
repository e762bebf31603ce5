"""Column functions: normalisers, keys, extraction, patterns."""
