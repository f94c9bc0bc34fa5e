"""Bi-temporal knowledge analytics on Spark DataFrames."""
