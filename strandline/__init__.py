"""Retrieval and usage analytics over code and documentation, as Spark DataFrames."""
