"""Fact-path analytics on Spark DataFrames."""
