"""Column functions: each takes columns and returns a column, so all stay inside Spark's code generation."""
