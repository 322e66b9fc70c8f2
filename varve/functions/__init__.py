"""Scalar functions: Column in, Column out, all of them built from Spark's own expressions."""
