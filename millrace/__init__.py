"""Corpus preparation and audit on Spark DataFrames."""
