"""Sparse linear-system analytics and training-data operators on Spark DataFrames."""
