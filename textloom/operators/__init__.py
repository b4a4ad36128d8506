"""Relational operators of the engine: each is a function from DataFrames to a DataFrame."""
