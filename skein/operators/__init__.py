"""Operators: each takes DataFrames and column names and returns a DataFrame."""
