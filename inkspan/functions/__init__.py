"""Scalar functions: Column expressions where Spark has the parts, Python only where it has not."""
