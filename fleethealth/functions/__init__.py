"""Column expressions that Spark has no built-in for."""
