"""Structured-text search, ranking and corpus analytics on Spark DataFrames."""
