"""Column expressions: rounding, geometry, text, and the fixed vocabularies."""
