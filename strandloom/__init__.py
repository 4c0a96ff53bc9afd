"""Sequence-similarity analytics on Spark DataFrames."""
