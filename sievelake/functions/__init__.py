"""Scalar functions. Every function takes and returns native Columns."""
