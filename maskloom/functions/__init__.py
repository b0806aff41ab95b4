"""Column expressions: hashing, rounding, and one masking rule per field type."""
