"""Retrieval analytics on Spark DataFrames."""
