"""Column expressions and Arrow-batch vector functions."""
