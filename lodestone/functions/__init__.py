"""Column expressions: text, masking and vectors."""
