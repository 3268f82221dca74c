"""Operators: DataFrames in, DataFrames out."""
