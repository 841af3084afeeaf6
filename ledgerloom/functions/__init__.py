"""Scalar functions as Column expressions, and the JSON merge."""
