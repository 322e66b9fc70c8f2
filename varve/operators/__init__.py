"""Operators: DataFrame in, DataFrame out, with column names as parameters."""
