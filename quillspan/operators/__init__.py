"""Operators: pure, lazy functions from DataFrames to DataFrames."""
