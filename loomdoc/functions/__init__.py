"""Column expressions: values, text and vectors."""
