"""Machinery condition monitoring on Spark DataFrames."""
