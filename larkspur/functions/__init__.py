"""Scalar functions: Column in, Column out, all built from Spark's own."""
