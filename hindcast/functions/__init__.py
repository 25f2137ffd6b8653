"""Scalar functions over columns, and seeds."""
