"""Operators: DataFrames in, a lazy DataFrame out. None reads the clock; times are parameters."""
